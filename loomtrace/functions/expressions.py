"""Column functions over expression facts: fingerprints, roles of blocks, names of effects."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DOMINANCE = ["CONSTANT", "DIRECT", "EXPAND_ALL", "UNION", "EXPRESSION", "CONDITIONAL", "WINDOW", "AGGREGATE"]


def normalized(text: Column) -> Column:
    """Lower case, white space folded."""
    return F.lower(F.regexp_replace(F.trim(text), r"\s+", " "))


def fingerprint(kind: Column, text: Column) -> Column:
    return F.concat_ws(":", kind, normalized(text))


def transform_rank(transform: Column) -> Column:
    """Strength of a transform: the strongest on a way names it; null for unknown names."""
    found = F.array_position(F.array(*[F.lit(t) for t in DOMINANCE]), transform)
    return F.when(found > 0, found - 1)


def dominant(transforms: Column) -> Column:
    """Strongest transform of an array of them."""
    return F.element_at(F.array(*[F.lit(t) for t in DOMINANCE]), (F.array_max(F.transform(transforms, transform_rank)) + 1).cast("int"))


def called_functions(text: Column) -> Column:
    """Names before an opening parenthesis, lower case, without SQL's own words; sorted and distinct."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"\b([A-Za-z_]\w*)\s*\("), F.lit(1)), F.lower)
    return F.sort_array(F.array_distinct(F.filter(found, lambda f: ~f.isin("cast", "case", "if", "over", "in", "and", "or", "not"))))


def is_partition_filter(fields: Column) -> Column:
    """Whether a predicate reads partition fields alone."""
    return (F.size(fields) > 0) & F.forall(fields, lambda f: F.lower(f).isin(*"biz_date bizdate ds dt pt".split()))

"""Table states over an ordered script: what each write does, which state each read saw, and where values come from.

Statements are ordered rows, so the state machine is window functions and as-of joins; a script's hops through
temporary relations are few and folded together in one grouped job.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtrace.operators.trace import TRACED, trace_statement, edges, sources
from loomtrace.plans.facts import Facts

FOLD_LIMIT = 16
KEEPS_PRIOR = ("APPEND", "MERGE", "CONDITIONAL_UPDATE", "ANTI_FILTER", "REPLACE_PARTITION", "RESET_PARTITION")


def effect() -> Column:
    """What a write does to its table's rows."""
    kind, parts, mode = F.col("kind"), F.col("partition_mode"), F.col("overwrite_mode")
    return (
        F.when(kind == "INSERT", "APPEND")
        .when((kind == "INSERT_OVERWRITE") & (parts == "none"), "REPLACE")
        .when((kind == "INSERT_OVERWRITE") & (parts == "dynamic") & (mode != "dynamic"), "REPLACE")
        .when(kind == "INSERT_OVERWRITE", "REPLACE_PARTITION")
        .when(kind == "CTAS", "REPLACE")
        .when(kind == "MERGE", "MERGE")
        .when((kind == "TRUNCATE") & (parts == "none"), "RESET")
        .when(kind == "TRUNCATE", "RESET_PARTITION")
        .when((kind == "DELETE") & F.col("has_predicate"), "ANTI_FILTER")
        .when(kind == "DELETE", "RESET")
        .when(kind == "UPDATE", "CONDITIONAL_UPDATE")
    )


def states(facts: Facts) -> DataFrame:
    """``(task, state, relation, ordinal, stmt, write_ordinal, effect, previous, session_scoped, is_final, overwrite_mode, overwrite_mode_source)``."""
    order = Window.partitionBy("task", "relation").orderBy("write_ordinal")
    every = Window.partitionBy("task", "relation")
    w = facts.statements.filter("write_ordinal is not null").withColumn("relation", F.lower("target")).withColumn("effect", effect())
    w = w.withColumn("ordinal", F.row_number().over(order)).withColumn("is_final", F.col("ordinal") == F.max("ordinal").over(every))
    name = lambda n: F.format_string("state:%s:%03d", F.col("relation"), n)
    # a relation that some statement makes temporary is temporary in all its states
    temporary = F.max(F.col("session_scoped").cast("int")).over(every) == 1
    w = w.withColumn("w_session", temporary)
    previous = F.when(F.col("effect").isin(*KEEPS_PRIOR) & (F.col("ordinal") > 1), name(F.col("ordinal") - 1))
    return w.select("task", name(F.col("ordinal")).alias("state"), "relation", "ordinal", "stmt", "write_ordinal", "effect", previous.alias("previous"), F.col("w_session").alias("session_scoped"), "is_final", "overwrite_mode", "overwrite_mode_source")


def reads(facts: Facts) -> DataFrame:
    """``(task, stmt, source, source_state)``: the state of each table that a statement read; null where the script hadn't written it before."""
    at = facts.statements.select("task", "stmt", "write_ordinal", F.col("target").alias("own"))
    seen = facts.inputs.filter("source_type = 'table'").select("task", "stmt", F.lower("source").alias("source")).distinct().join(at, ["task", "stmt"]).filter("write_ordinal is not null")
    s = states(facts).select("task", F.col("relation").alias("source"), "state", F.col("write_ordinal").alias("made"))
    met = seen.join(s, ["task", "source"], "left").filter("made is null or made < write_ordinal")
    known = met.groupBy("task", "stmt", "source").agg(F.max_by("state", "made").alias("source_state"))
    return seen.select("task", "stmt", "source").join(known, ["task", "stmt", "source"], "left")


def state_values(facts: Facts) -> DataFrame:
    """``(task, state, column, source, source_column, source_state, transform)``: value sources of each state's columns.

    A state that keeps prior rows also has its previous state's columns as sources (``source`` is then its own relation).
    """
    s = states(facts)
    traced = sources(facts).filter("role = 'value' and source_kind in ('physical', 'rowset')").withColumn("source", F.lower("source"))
    made = s.select("task", "stmt", "state").join(traced, ["task", "stmt"]).join(reads(facts), ["task", "stmt", "source"], "left")
    own = made.select("task", "state", F.lower("column").alias("column"), "source", F.lower("source_column").alias("source_column"), "source_state", "transform")
    columns = own.select("task", "state", "column").distinct()
    named = s.select("task", "relation", "state").join(columns, ["task", "state"]).select("task", "relation", "column").distinct()
    keeps = s.filter("previous is not null").join(named, ["task", "relation"])
    prior = keeps.select("task", "state", "column", F.col("relation").alias("source"), F.col("column").alias("source_column"), F.col("previous").alias("source_state"), F.lit("DIRECT").alias("transform"))
    return own.unionByName(prior).distinct()


def conditions(facts: Facts) -> DataFrame:
    """``(task, state, kind, source, source_column)``: physical fields that decide which rows a state holds or changes.

    Conditions of inner blocks count as well, and fields of inner blocks are traced to what they come from.
    """
    root = F.when(F.col("scope").like("ROOT%"), F.col("scope")).otherwise("ROOT")
    asked = facts.predicate_fields.select("task", "stmt", root.alias("scope"), F.concat(F.lit("?"), F.col("kind")).alias("column"), F.lit("DIRECT").alias("transform"), "src_scope", "src_column", F.lit("value").alias("role"))
    traced = edges(facts).unionByName(asked).groupBy("task", "stmt").applyInPandas(trace_statement, TRACED).filter("column like '?%' and source_kind = 'physical' and role = 'value'")
    s = states(facts).select("task", "stmt", "state")
    return s.join(traced, ["task", "stmt"]).select("task", "state", F.substring("column", 2, 100).alias("kind"), F.lower("source").alias("source"), F.lower("source_column").alias("source_column")).distinct()


_FOLDED = "task string, state string, column string, source string, source_column string, source_state string, transform string, reason string"


def _fold(limit: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.astype(object).where(rows.notna(), None)
        known = rows[rows["column"].isna()]
        session = set(known[known["session_scoped"] == True]["state"])  # noqa: E712
        names = set(known[known["session_scoped"] == True]["relation"])  # noqa: E712
        values = list(rows[rows["column"].notna()][["state", "column", "source", "source_column", "source_state", "transform"]].itertuples(index=False, name=None))
        inner: dict[tuple[str, str], set[tuple]] = {}
        for state, column, source, source_column, source_state, transform in values:
            inner.setdefault((state, column), set()).add((source, source_column, source_state, transform))
            # a rowset of a temporary relation is the rowsets of what that relation was made from
            inner.setdefault((state, "*"), set()).add((source, "*", source_state, "DIRECT"))
        now = {(*v, None) for v in values if v[0] not in session}
        for _ in range(limit):
            open_ = {v for v in now if v[4] in session and v[6] is None}
            if not open_:
                break
            now -= open_
            for state, column, source, source_column, source_state, transform, _why in open_:
                met = inner.get((source_state, source_column))
                if met is None:
                    now.add((state, column, source, source_column, source_state, transform, "source_column_not_in_document"))
                for i_source, i_column, i_state, i_transform in met or ():
                    now.add((state, column, i_source, i_column, i_state, transform if i_transform == "DIRECT" else i_transform, None))
        task = rows["task"].iloc[0]
        made = []
        for state, column, source, source_column, source_state, transform, why in sorted(now, key=str):
            if source_state in session and why is None:
                why = "fold_depth_exceeded"
            elif source in names and source_state is None:
                why = "source_state_not_in_document"
            made.append((task, state, column, source, source_column, source_state, transform, why))
        return pd.DataFrame(made, columns=["task", "state", "column", "source", "source_column", "source_state", "transform", "reason"])

    return run


def fold_sessions(facts: Facts, limit: int = FOLD_LIMIT) -> DataFrame:
    """State values with hops through temporary relations replaced by what those hold.

    A hop stays, with its reason, past ``limit`` hops (``fold_depth_exceeded``), where the temporary
    relation's state is not in the script (``source_state_not_in_document``) or has no such column
    (``source_column_not_in_document``).  Values of temporary relations themselves are dropped.  A script's values
    are folded in one grouped job; scripts spread over executors.
    """
    values = state_values(facts)
    known = states(facts).select("task", "state", "relation", "session_scoped")
    return values.unionByName(known, allowMissingColumns=True).groupBy("task").applyInPandas(_fold(limit), _FOLDED)


def final_states(facts: Facts) -> DataFrame:
    """Last state of each lasting relation of each script."""
    return states(facts).filter("is_final and not session_scoped").select("task", "relation", "state", "effect")


def coverage(facts: Facts, known_tables: DataFrame) -> DataFrame:
    """``(task, relation, covered_by)``: metadata, script (columns proven by the script itself) or null for none.

    ``known_tables`` has a column ``relation``.
    """
    read = facts.inputs.filter("source_type = 'table'").select("task", F.lower("source").alias("relation"))
    every = read.union(states(facts).select("task", "relation")).distinct()
    local = facts.statements.filter("kind = 'CTAS'").join(facts.scopes.filter("scope like 'ROOT%' and not has_star"), ["task", "stmt"], "left_semi").select("task", F.lower("target").alias("relation"), F.lit("script").alias("s")).distinct()
    given = known_tables.select(F.lower("relation").alias("relation"), F.lit("metadata").alias("m")).distinct()
    return every.join(given, "relation", "left").join(local, ["task", "relation"], "left").select("task", "relation", F.coalesce("m", "s").alias("covered_by"))


def blocking_reasons(facts: Facts, columns: DataFrame, conflicts: DataFrame | None = None) -> DataFrame:
    """``(task, rank, reason, relation)``: why a script's lineage may be incomplete, causes before symptoms.

    1 ``metadata_conflict``: sources of metadata contradict each other (``conflicts`` has a column ``relation``; kept whether a
    script reads it or not, under the task ``*``); 2 ``metadata_missing``: a relation that the script reads, writes or decides
    rows by has no known columns; 3 ``root_gap``: a target column whose trace is open.
    """
    from loomtrace.operators.audit import gaps

    member = conditions(facts).select("task", F.col("source").alias("relation")).distinct()
    known = coverage(facts, columns).filter("covered_by is null").select("task", "relation")
    missing = known.union(member.join(columns.select(F.lower("relation").alias("relation")).distinct(), "relation", "left_anti").join(coverage(facts, columns).filter("covered_by is not null"), ["task", "relation"], "left_anti").select("task", "relation")).distinct()
    out = missing.select("task", F.lit(2).alias("rank"), F.lit("metadata_missing").alias("reason"), "relation")
    open_ = gaps(facts).filter("root_impact").join(facts.statements.select("task", "stmt", "target"), ["task", "stmt"]).select("task", F.lit(3), F.lit("root_gap"), F.concat_ws(".", "target", "column")).distinct()
    out = out.union(open_)
    if conflicts is not None:
        out = out.union(conflicts.select(F.lit("*"), F.lit(1), F.lit("metadata_conflict"), "relation").distinct())
    return out

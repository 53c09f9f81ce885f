"""Links between facts: what aligns in a set operation, what an outer filter decides, which targets a block reaches,
which physical fields a join compares.

Small per-statement graphs are walked in grouped Arrow jobs, one statement a group; the rest are joins of fact tables.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtrace.operators.trace import TRACED, edges, trace_statement
from loomtrace.plans.facts import Facts

KEY = ["task", "stmt", "scope"]
PSEUDO = ("CONSTANT", "SYSTEM", "UNKNOWN", "AMBIGUOUS")


def _traced(facts: Facts, asked: DataFrame) -> DataFrame:
    """Physical, generated and open sources of ``asked`` ``(task, stmt, column, src_scope, src_column)``; ``column`` names the question."""
    rows = asked.select("task", "stmt", F.lit("ROOT").alias("scope"), F.concat(F.lit("?"), "column").alias("column"), F.lit("DIRECT").alias("transform"), "src_scope", "src_column", F.lit("value").alias("role"))
    found = edges(facts).unionByName(rows).groupBy("task", "stmt").applyInPandas(trace_statement, TRACED).filter("column like '?%' and role = 'value'")
    return found.withColumn("column", F.substring("column", 2, 1 << 20))


def union_alignment(facts: Facts) -> DataFrame:
    """``(task, stmt, scope, ord, column, branch, branch_scope, branch_column, expression, status)``: what each branch gives at each place of a set operation.

    ``status`` is aligned, missing (the branch has fewer columns), or surplus (a place that the first branch does not have).
    """
    unions = facts.scopes.filter("kind = 'union'").select(*KEY)
    branches = facts.inputs.join(unions, KEY).select(*KEY, F.col("ord").alias("branch"), F.col("source").alias("branch_scope"))
    own = facts.columns.join(unions, KEY).select(*KEY, "ord", "column")
    given = facts.columns.select("task", "stmt", F.col("scope").alias("branch_scope"), "ord", F.col("column").alias("branch_column"), "expression")
    told = branches.join(given, ["task", "stmt", "branch_scope"]).select(*KEY, "branch", "branch_scope", "ord", "branch_column", "expression")
    wanted = branches.join(own, KEY).select(*KEY, "branch", "branch_scope", "ord", "column")
    met = wanted.join(told, [*KEY, "branch", "branch_scope", "ord"], "full")
    status = F.when(F.col("branch_column").isNull(), "missing").when(F.col("column").isNull(), "surplus").otherwise("aligned")
    return met.select(*KEY, "ord", "column", "branch", "branch_scope", "branch_column", "expression", status.alias("status"))


def branch_sources(facts: Facts) -> DataFrame:
    """``(task, stmt, scope, column, branch, source_kind, source, source_column)``: where each branch's share of a set operation's output comes from."""
    a = union_alignment(facts).filter("status = 'aligned'").withColumn("n", F.format_string("%s|%d|%d", "scope", "ord", "branch"))
    asked = a.select("task", "stmt", F.col("n").alias("column"), F.col("branch_scope").alias("src_scope"), F.col("branch_column").alias("src_column"))
    found = _traced(facts, asked).select("task", "stmt", F.col("column").alias("n"), "source_kind", "source", "source_column").distinct()
    return a.select(*KEY, "column", "branch", "n").join(found, ["task", "stmt", "n"]).drop("n").select(*KEY, "column", "branch", "source_kind", "source", "source_column")


def window_filters(facts: Facts) -> DataFrame:
    """``(task, stmt, window_scope, window_column, filter_scope, kind, expression)``: conditions on a window's output, as in keeping the first row of each group."""
    windows = facts.columns.filter("transform = 'WINDOW'").select("task", "stmt", F.col("scope").alias("window_scope"), F.col("column").alias("window_column"))
    used = facts.predicate_fields.select("task", "stmt", F.col("scope").alias("filter_scope"), "ord", "kind", F.col("src_scope").alias("window_scope"), F.lower("src_column").alias("c"))
    met = windows.withColumn("c", F.lower("window_column")).join(used, ["task", "stmt", "window_scope", "c"])
    text = facts.predicates.select("task", "stmt", F.col("scope").alias("filter_scope"), "ord", "kind", "expression")
    return met.join(text, ["task", "stmt", "filter_scope", "ord", "kind"]).select("task", "stmt", "window_scope", "window_column", "filter_scope", "kind", "expression").distinct()


def _reach(rows: pd.DataFrame) -> pd.DataFrame:
    up: dict[tuple[str, str], set[tuple[str, str]]] = {}
    name: dict[tuple[str, str], str] = {}
    for scope, column, src, col in rows[["scope", "column", "src_scope", "src_column"]].itertuples(index=False):
        name.setdefault((scope, column.lower()), column)
        up.setdefault((scope, column.lower()), set()).add((src, col.lower()))
    out = []
    for root in sorted(k for k in up if k[0].split("_")[0] == "ROOT"):
        seen, todo = {root}, [root]
        while todo:
            for x in up.get(todo.pop(), ()):
                for y in [k for k in up if k[0] == x[0]] if x[1] == "*" else [x]:
                    if y in up and y not in seen:
                        seen.add(y)
                        todo.append(y)
        out += [(s, name[s, c], name[root]) for s, c in seen]
    task, stmt = rows["task"].iloc[0], rows["stmt"].iloc[0]
    return pd.DataFrame([(task, stmt, *x) for x in sorted(set(out))], columns=["task", "stmt", "scope", "column", "target"])


def target_reach(facts: Facts) -> DataFrame:
    """``(task, stmt, scope, column, target)``: each target column that an output of a block takes part in, as value, window or filter context."""
    return facts.column_sources.select(*KEY, "column", "src_scope", "src_column").groupBy("task", "stmt").applyInPandas(_reach, "task string, stmt string, scope string, column string, target string")


def scope_outputs(facts: Facts) -> DataFrame:
    """``(task, stmt, scope, column, role, grain_effect, downstream, targets)``: blocks that read an output, and the target columns it reaches."""
    reads = facts.column_sources.filter(~F.col("src_scope").isin(*PSEUDO)).select("task", "stmt", F.col("src_scope").alias("scope"), F.lower("src_column").alias("c"), F.col("scope").alias("by"))
    down = reads.groupBy(*KEY, "c").agg(F.array_join(F.sort_array(F.collect_set("by")), ",").alias("downstream"))
    reach = target_reach(facts).groupBy(*KEY, F.lower("column").alias("c")).agg(F.array_join(F.sort_array(F.collect_set("target")), ",").alias("targets"))
    own = facts.columns.select(*KEY, "column", "role", "grain_effect").withColumn("c", F.lower("column"))
    return own.join(down, [*KEY, "c"], "left").join(reach, [*KEY, "c"], "left").select(*KEY, "column", "role", "grain_effect", F.coalesce("downstream", F.lit("")).alias("downstream"), F.coalesce("targets", F.lit("")).alias("targets"))


def block_targets(facts: Facts) -> DataFrame:
    """``(task, stmt, scope, type, expression, targets)``: target columns that each piece of logic decides.

    A computed column decides what its output reaches; a condition on rows, a join, a grouping or DISTINCT decides
    everything that its block puts out.
    """
    reach = target_reach(facts)
    column = facts.columns.filter("transform in ('CONDITIONAL', 'WINDOW', 'AGGREGATE')").select(*KEY, F.when(F.col("transform") == "CONDITIONAL", "case_when").otherwise(F.lower("transform")).alias("type"), "expression", "column")
    by_column = column.join(reach, [*KEY, "column"]).select(*KEY, "type", "expression", "target")
    rows = facts.predicates.select(*KEY, F.when(F.col("kind") == "having", "having").when(F.col("kind") == "join_on", "join").otherwise("filter").alias("type"), "expression")
    rows = rows.union(facts.joins.select(*KEY, F.lit("join"), F.concat_ws(" ", "join_type", "left_inputs", "right_inputs", "condition")))
    rows = rows.union(facts.groupings.select(*KEY, F.lit("group_by"), "expression").distinct()).union(facts.scopes.filter("is_distinct").select(*KEY, F.lit("distinct"), "scope"))
    by_rows = rows.join(reach.select(*KEY, "target").distinct(), KEY).select(*KEY, "type", "expression", "target")
    return by_column.union(by_rows).groupBy(*KEY, "type", "expression").agg(F.array_join(F.sort_array(F.collect_set("target")), ",").alias("targets"))


def physical_join_keys(facts: Facts) -> DataFrame:
    """``(task, stmt, scope, ord, origin, left_table, left_field, right_table, right_field)``: join keys traced through blocks to the physical fields they compare."""
    number = F.row_number().over(Window.partitionBy("task", "stmt").orderBy("scope", "ord", "left_alias", "left_column", "right_alias", "right_column"))
    keys = facts.join_keys.withColumn("k", number)
    alias = facts.inputs.select(*KEY, "alias", F.col("source").alias("src_scope"))

    def side(s: str) -> DataFrame:
        asked = keys.select(*KEY, "k", F.col(f"{s}_alias").alias("alias"), F.col(f"{s}_column").alias("src_column")).join(alias, [*KEY, "alias"])
        return asked.select("task", "stmt", F.format_string(f"{s}:%d", "k").alias("column"), "src_scope", "src_column")

    found = _traced(facts, side("left").union(side("right"))).filter("source_kind = 'physical'")
    fields = lambda s: found.filter(F.col("column").startswith(f"{s}:")).select("task", "stmt", F.substring_index("column", ":", -1).cast("int").alias("k"), F.col("source").alias(f"{s}_table"), F.col("source_column").alias(f"{s}_field")).distinct()
    return keys.select(*KEY, "ord", "origin", "k").join(fields("left"), ["task", "stmt", "k"]).join(fields("right"), ["task", "stmt", "k"]).drop("k").select(*KEY, "ord", "origin", "left_table", "left_field", "right_table", "right_field")


def _below(rows: pd.DataFrame) -> pd.DataFrame:
    up: dict[str, set[tuple[str, str]]] = {}
    for scope, source, kind in rows[["scope", "source", "source_type"]].itertuples(index=False):
        up.setdefault(scope, set()).add((source, kind))
    out = []
    for scope in up:
        seen, todo = set(), [scope]
        while todo:
            for source, kind in up.get(todo.pop(), ()):
                if (source, kind) not in seen:
                    seen.add((source, kind))
                    if kind != "table":
                        todo.append(source)
        out += [(scope, s) for s, kind in seen if kind == "table"]
    task, stmt = rows["task"].iloc[0], rows["stmt"].iloc[0]
    return pd.DataFrame([(task, stmt, *x) for x in sorted(out)], columns=["task", "stmt", "scope", "source"])


def physical_inputs(facts: Facts) -> DataFrame:
    """``(task, stmt, scope, source)``: tables that a block reads, itself or through the blocks below it."""
    direct = facts.inputs.select(*KEY, "source", "source_type")
    nested = facts.scope_edges.select("task", "stmt", F.col("downstream").alias("scope"), F.col("upstream").alias("source"), F.lit("scope").alias("source_type"))
    return direct.union(nested).groupBy("task", "stmt").applyInPandas(_below, "task string, stmt string, scope string, source string")


def alias_bindings(facts: Facts) -> DataFrame:
    """``(task, stmt, scope, alias, source, source_type, tables)``: what an alias stands for, down to tables."""
    below = physical_inputs(facts).select("task", "stmt", F.col("scope").alias("source"), F.col("source").alias("t"))
    inner = facts.inputs.join(below, ["task", "stmt", "source"], "left").groupBy(*KEY, "alias", "source", "source_type").agg(F.array_join(F.sort_array(F.collect_set("t")), ",").alias("inner"))
    return inner.select(*KEY, "alias", "source", "source_type", F.when(F.col("source_type") == "table", F.col("source")).otherwise(F.col("inner")).alias("tables"))


def expression_bindings(facts: Facts) -> DataFrame:
    """``(task, stmt, scope, column, alias, field, path, role)``: which alias gives which field to an expression."""
    alias = facts.inputs.select(*KEY, "alias", F.col("source").alias("src_scope"))
    return facts.column_sources.join(alias, [*KEY, "src_scope"]).select(*KEY, "column", "alias", F.col("src_column").alias("field"), F.col("src_path").alias("path"), "role").distinct()


def predicate_dependencies(facts: Facts) -> DataFrame:
    """``(task, stmt, scope, kind, expression, inner_scope, tables)``: queries nested in a condition and the tables that they read."""
    below = physical_inputs(facts).groupBy("task", "stmt", F.col("scope").alias("inner_scope")).agg(F.array_join(F.sort_array(F.collect_set("source")), ",").alias("tables"))
    text = facts.predicates.select(*KEY, "ord", "kind", "expression")
    return facts.predicate_scopes.join(text, [*KEY, "ord", "kind"]).join(below, ["task", "stmt", "inner_scope"], "left").select(*KEY, "kind", "expression", "inner_scope", F.coalesce("tables", F.lit("")).alias("tables"))


def aggregation_detail(facts: Facts) -> DataFrame:
    """``(task, stmt, scope, group_items, aggregate_items, having, status)`` of each block that groups or aggregates.

    ``status`` is partial where a source of a group item or aggregate is ambiguous or unknown.
    """
    items = facts.groupings.select(*KEY, "ord", "expression").distinct().groupBy(*KEY).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "expression"))), lambda x: x["expression"]), "; ").alias("group_items"))
    call = F.concat("column", F.lit("="), "function", F.lit("("), F.when(F.col("is_distinct"), "DISTINCT ").otherwise(""), "argument", F.lit(")"), F.when(F.col("filter").isNotNull(), F.concat(F.lit(" FILTER "), "filter")).otherwise(""))
    made = facts.aggregates.groupBy(*KEY).agg(F.array_join(F.sort_array(F.collect_list(call)), "; ").alias("aggregate_items"))
    having = facts.predicates.filter("kind = 'having'").groupBy(*KEY).agg(F.array_join(F.sort_array(F.collect_list("expression")), "; ").alias("having"))
    bad = facts.column_sources.filter("transform = 'AGGREGATE' and src_scope in ('UNKNOWN', 'AMBIGUOUS')").select(*KEY).union(facts.groupings.filter("src_scope in ('UNKNOWN', 'AMBIGUOUS')").select(*KEY)).distinct().withColumn("bad", F.lit(True))
    every = items.join(made, KEY, "full").join(having, KEY, "left").join(bad, KEY, "left")
    empty = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return every.select(*KEY, empty("group_items"), empty("aggregate_items"), empty("having"), F.when(F.col("bad"), "partial").otherwise("complete").alias("status"))


def window_detail(facts: Facts) -> DataFrame:
    """``(task, stmt, scope, column, function, argument, partition_by, order_by, frame, status)`` of each window."""
    bad = facts.column_sources.filter("transform = 'WINDOW' and src_scope in ('UNKNOWN', 'AMBIGUOUS')").select(*KEY, "column").distinct().withColumn("bad", F.lit(True))
    text = lambda c: F.array_join(c, ", ").alias(c)
    return facts.windows.join(bad, [*KEY, "column"], "left").select(*KEY, "column", "function", "argument", text("partition_by"), text("order_by"), "frame", F.when(F.col("bad"), "partial").otherwise("complete").alias("status"))


def first_writes(facts: Facts) -> tuple[DataFrame, DataFrame]:
    """(statements with only the first write of each script, ``(task, stmt, type, detail)`` of the writes that this leaves out)."""
    s = facts.statements
    later = F.col("write_ordinal") > 1
    dropped = s.filter(later).select("task", "stmt", F.lit("write_statement_dropped").alias("type"), F.concat_ws(" ", "kind", "target").alias("detail"))
    return s.filter("write_ordinal is null or write_ordinal = 1"), dropped


def chains(facts: Facts) -> DataFrame:
    """``(task, stmt, chain, target, step_no, scope, column, expression, expanded)``: mapping chains with their numbers.

    A step that an earlier chain of the statement has already is left out, and ``expanded`` is null where it repeats ``expression``.
    """
    from loomtrace.operators.trace import mapping_steps

    place = facts.columns.filter("scope like 'ROOT%'").groupBy("task", "stmt", F.col("column").alias("target")).agg(F.min("ord").alias("at"))
    steps = mapping_steps(facts).join(place, ["task", "stmt", "target"])
    number = F.dense_rank().over(Window.partitionBy("task", "stmt").orderBy("at", "target"))
    first = F.row_number().over(Window.partitionBy("task", "stmt", "scope", "column").orderBy("n", "step_no"))
    one = steps.withColumn("n", number).withColumn("first", first).filter("first = 1")
    text = facts.expansions.select(*KEY, "column", "expanded")
    met = one.join(text, [*KEY, "column"], "left")
    return met.select("task", "stmt", F.format_string("mc:%03d", "n").alias("chain"), "target", "step_no", "scope", "column", "expression", F.when(F.col("expanded") != F.col("expression"), F.col("expanded")).alias("expanded"))

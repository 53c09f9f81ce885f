"""End-to-end lineage: from each output of a write back to physical columns.

Edges of one statement are few and always travel together, so the closure runs inside a grouped Arrow job,
one statement a group; statements spread over the cluster.  Tables that feed each other across statements
and scripts form one large graph; its closure doubles path lengths with self-joins.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtrace.plans.facts import Facts
from loomtrace.plans.reader import AMBIGUOUS, CONSTANT, SYSTEM, UNKNOWN

#: Weakest to strongest: the strongest transform on a way names it.
DOMINANCE = ["CONSTANT", "DIRECT", "EXPAND_ALL", "UNION", "EXPRESSION", "CONDITIONAL", "WINDOW", "AGGREGATE"]
_RANK = {t: i for i, t in enumerate(DOMINANCE)}
TRACED = "task string, stmt string, column string, source_kind string, source string, source_column string, transform string, role string, hops int"


def edges(facts: Facts) -> DataFrame:
    """All steps that values take: column sources, and rowsets through a scope's inputs."""
    key = ["task", "stmt", "scope"]
    values = facts.column_sources.select(*key, "column", "transform", "src_scope", "src_column", "role")
    rows = facts.inputs.select(*key, F.lit("*rows").alias("column"), F.lit("DIRECT").alias("transform"), F.col("source").alias("src_scope"), F.lit("*rows").alias("src_column"), F.lit("rowset").alias("role"))
    return values.unionByName(rows)


def trace_statement(rows: pd.DataFrame) -> pd.DataFrame:
    step: dict[tuple[str, str], list[tuple[str, str, str, str]]] = {}
    scopes: set[str] = set(rows["scope"])
    for scope, column, transform, src, col, role in rows[["scope", "column", "transform", "src_scope", "src_column", "role"]].itertuples(index=False):
        step.setdefault((scope, column.lower()), []).append((transform, src, col, role))
    out: dict[tuple, tuple[int, int]] = {}

    def emit(target: str, kind: str, source: str, column: str, rank: int, role: str, hops: int) -> None:
        at = (target, kind, source, column, role)
        old = out.get(at)
        out[at] = (max(rank, old[0]), min(hops, old[1])) if old else (rank, hops)

    def walk(target: str, scope: str, column: str, rank: int, role: str, hops: int, way: frozenset, seen: set) -> None:
        at = (scope, column.lower())
        if at in way:
            if scope.startswith("cte:"):  # a recursive block: its other branches say where its values come from
                return
            emit(target, "unresolved", "cycle_detected", f"{scope}.{column}", rank, role, hops)
            return
        if (at, rank, role) in seen:
            return
        seen.add((at, rank, role))
        found = step.get(at)
        if found is None:
            found = step.get((scope, "*"))
            if found is None:
                emit(target, "unresolved", "missing_scope_column", f"{scope}.{column}", rank, role, hops)
                return
            found = [(t, src, column if col == "*" else col, r) for t, src, col, r in found]
        for transform, src, col, r in found:
            now = max(rank, _RANK[transform])
            r = role if r in ("value", "rowset") else r
            if src in (CONSTANT, SYSTEM):
                emit(target, "generated", src, col, now, r, hops)
            elif src == UNKNOWN:
                emit(target, "unresolved", "unknown_source", col, now, r, hops)
            elif src == AMBIGUOUS:
                emit(target, "unresolved", "ambiguous_unqualified", col, now, r, hops)
            elif src in scopes:
                star = col in ("*", "*rows") and now >= _RANK["WINDOW"]
                walk(target, src, "*rows" if star else col, now, r, hops + 1, way | {at}, seen)
            elif col in ("*", "*rows"):
                if col == "*rows" or now >= _RANK["WINDOW"]:
                    emit(target, "rowset", src, "*", now, r, hops)
                else:
                    emit(target, "unresolved", "star_not_expanded", src, now, r, hops)
            else:
                emit(target, "physical", src, col, now, r, hops)

    roots = sorted({s for s in scopes if s.split("_")[0] == "ROOT"})
    for root in roots:
        for scope, column in list(step):
            if scope == root and column != "*rows":
                name = next(c for s, c in zip(rows["scope"], rows["column"]) if s == root and c.lower() == column)
                walk(name, root, column, 0, "value", 0, frozenset(), set())
    task, stmt = rows["task"].iloc[0], rows["stmt"].iloc[0]
    made = [(task, stmt, *at[:4], DOMINANCE[rank], at[4], hops) for at, (rank, hops) in out.items()]
    return pd.DataFrame(made, columns=["task", "stmt", "column", "source_kind", "source", "source_column", "transform", "role", "hops"])


def sources(facts: Facts) -> DataFrame:
    """One row for each (output, source): kind, dominant transform, role, and scopes in between.

    ``source_kind`` is physical, generated, rowset or unresolved; for the last, ``source`` is the reason.
    ``role`` is value, or partition, order, filter for window and pivot context, or candidate of an ambiguous name.
    """
    return edges(facts).groupBy("task", "stmt").applyInPandas(trace_statement, TRACED)


def end_to_end(facts: Facts) -> DataFrame:
    """One row for each output: its sources as a sorted array, their kind, dominant transform and completeness."""
    one = F.struct("source", "source_column", "transform")
    value = F.col("role") == "value"
    made = sources(facts).groupBy("task", "stmt", "column").agg(
        F.sort_array(F.collect_set(F.when(value & (F.col("source_kind") == "physical"), one))).alias("physical"),
        F.sort_array(F.collect_set(F.when(value & (F.col("source_kind") == "rowset"), F.col("source")))).alias("rowsets"),
        F.sort_array(F.collect_set(F.when(value & (F.col("source_kind") == "generated"), F.col("source_column")))).alias("generated"),
        F.sort_array(F.collect_set(F.when(F.col("role").isin("partition", "order"), F.struct("role", "source", "source_column")))).alias("window_context"),
        F.sort_array(F.collect_set(F.when(F.col("role") == "candidate", F.concat_ws(".", "source", "source_column")))).alias("candidates"),
        F.sort_array(F.collect_set(F.when(value & (F.col("source_kind") == "unresolved"), F.col("source")))).alias("reasons"),
    )
    has = lambda c: F.size(c) > 0
    kind = F.when(has("reasons") & ~has("physical"), "unresolved").when(has("physical") & (has("generated") | has("rowsets")), "mixed").when(has("physical"), "physical").when(has("rowsets"), "rowset").otherwise("generated")
    return made.withColumn("source_kind", kind).withColumn("trace_complete", ~has("reasons"))


def closure(pairs: DataFrame, up: str = "upstream", down: str = "downstream", max_rounds: int = 40) -> DataFrame:
    """Transitive closure ``(upstream, downstream, distance)`` of a directed graph, cycles allowed.

    Path lengths double in each round; a round is a join on the node in the middle and is cut in the
    shared checkpoint folder.
    """
    from loomtrace.operators.lineage_io import cut

    now = cut(pairs.select(F.col(up).alias("u"), F.col(down).alias("d")).filter("u <> d").distinct().withColumn("n", F.lit(1)))
    count = now.count()
    for _ in range(max_rounds):
        a, b = now.alias("a"), now.alias("b")
        longer = a.join(b, F.col("a.d") == F.col("b.u")).select(F.col("a.u").alias("u"), F.col("b.d").alias("d"), (F.col("a.n") + F.col("b.n")).alias("n")).filter("u <> d")
        now = cut(now.union(longer).groupBy("u", "d").agg(F.min("n").alias("n")))
        mark = now.agg(F.count("*"), F.sum("n")).first()
        if tuple(mark) == count:
            break
        count = tuple(mark)
    else:
        raise RuntimeError(f"closure did not settle in {max_rounds} rounds")
    return now.select(F.col("u").alias("upstream"), F.col("d").alias("downstream"), F.col("n").alias("distance"))


def table_edges(facts: Facts) -> DataFrame:
    """``(upstream, downstream)`` pairs of tables, by any value, rowset or row condition of a write."""
    target = facts.statements.filter("target <> ''").select("task", "stmt", F.col("target").alias("downstream"))
    read = facts.inputs.filter("source_type = 'table'").select("task", "stmt", F.col("source").alias("upstream"))
    return read.join(target, ["task", "stmt"]).select("upstream", "downstream").distinct()


def mapping_steps(facts: Facts) -> DataFrame:
    """Ordered steps of every output's chain, from physical fields up to the target: ``(task, stmt, target, step_no, scope, column, transform, expression)``."""
    steps = edges(facts).groupBy("task", "stmt").applyInPandas(_chains, "task string, stmt string, target string, step_no int, scope string, column string")
    return steps.join(facts.columns.select("task", "stmt", "scope", "column", "transform", "expression"), ["task", "stmt", "scope", "column"], "left")


def chain_text(facts: Facts) -> DataFrame:
    """``(task, stmt, target, chain)``: each output's steps as one line, sources first."""
    step = F.format_string("%s.%s: %s", F.col("scope"), F.col("column"), F.coalesce("expression", F.lit("")))
    by = mapping_steps(facts).groupBy("task", "stmt", "target").agg(F.sort_array(F.collect_set(F.struct("step_no", step.alias("text")))).alias("steps"))
    return by.select("task", "stmt", "target", F.array_join(F.transform("steps", lambda s: s["text"]), " -> ").alias("chain"))


def _chains(rows: pd.DataFrame) -> pd.DataFrame:
    step: dict[tuple[str, str], list[tuple[str, str]]] = {}
    named: dict[tuple[str, str], str] = {}
    for scope, column, src, col, role in rows[["scope", "column", "src_scope", "src_column", "role"]].itertuples(index=False):
        named[(scope, column.lower())] = column
        if role == "value":
            step.setdefault((scope, column.lower()), []).append((src, col.lower()))
    made: list[tuple] = []
    task, stmt = rows["task"].iloc[0], rows["stmt"].iloc[0]
    for at in sorted(k for k in named if k[0].split("_")[0] == "ROOT" and k[1] != "*rows"):
        done: dict[tuple[str, str], None] = {}
        stack: list[tuple[tuple[str, str], bool]] = [(at, False)]
        open_now: set = set()
        while stack:  # post-order: sources before what they feed
            node, ready = stack.pop()
            if ready:
                done.setdefault(node)
                continue
            if node in done or node in open_now or node not in named:
                continue
            open_now.add(node)
            stack.append((node, True))
            stack += [(x, False) for x in reversed(step.get(node, []))]
        made += [(task, stmt, named[at], n + 1, node[0], named[node]) for n, node in enumerate(done)]
    return pd.DataFrame(made, columns=["task", "stmt", "target", "step_no", "scope", "column"])


def scope_order(facts: Facts) -> DataFrame:
    """``(task, stmt, scope, level)``: topological level of each query block, sources at 0."""
    return facts.scopes.select("task", "stmt", "scope").join(facts.scope_edges.select("task", "stmt", F.col("downstream").alias("scope"), "upstream"), ["task", "stmt", "scope"], "left").groupBy("task", "stmt").applyInPandas(_levels, "task string, stmt string, scope string, level int")


def _levels(rows: pd.DataFrame) -> pd.DataFrame:
    ups: dict[str, set[str]] = {}
    for scope, up in rows[["scope", "upstream"]].itertuples(index=False):
        ups.setdefault(scope, set()).update([up] if isinstance(up, str) else [])
    level: dict[str, int] = {}
    rest = set(ups)
    while rest:
        ready = {s for s in rest if all(u in level or u not in ups for u in ups[s])} or {min(rest)}  # a circle opens at its least name
        level |= {s: 1 + max([level[u] for u in ups[s] if u in level], default=-1) for s in ready}
        rest -= ready
    task, stmt = rows["task"].iloc[0], rows["stmt"].iloc[0]
    return pd.DataFrame([(task, stmt, s, n) for s, n in sorted(level.items())], columns=["task", "stmt", "scope", "level"])

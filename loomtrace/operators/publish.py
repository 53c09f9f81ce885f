"""Facts as documents: JSON for each statement and script, Markdown mappings and warnings.

Documents are aggregations over the fact tables, so a corpus of any size is written by executors.
Every list is sorted, so equal facts give equal bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtrace.operators.audit import cross_references, gaps, relations, statistics
from loomtrace.operators.links import chains
from loomtrace.operators.states import states
from loomtrace.operators.trace import end_to_end, mapping_steps, scope_order
from loomtrace.plans.facts import Facts

VERSION_1, VERSION_2 = "1.0", "2.0"
ENUMS = {
    "kind": "CTAS INSERT INSERT_OVERWRITE MERGE DELETE TRUNCATE UPDATE SELECT OTHER COMMENT EMPTY FAILED".split(),
    "category": "row_mutation projection_write conditional_write unsupported_statement control_statement empty_statement".split(),
    "model_status": "failed ignored modeled unsupported".split(),
    "partition_mode": "dynamic mixed none static".split(),
    "syntax_status": "failed recovered strict_ok".split(),
}


class InvalidFacts(ValueError):
    """Facts that contradict themselves; nothing is written."""


def _list(df: DataFrame, name: str, *cols: str) -> DataFrame:
    return df.groupBy("task", "stmt").agg(F.sort_array(F.collect_list(F.struct(*cols))).alias(name))


def _text(body: Column, compact: bool) -> Column:
    return F.to_json(body, {"pretty": str(not compact).lower()})


def _bodies(facts: Facts, columns: DataFrame | None = None) -> DataFrame:
    """``(task, stmt, body)``: the struct behind each write statement's document; ``columns``: metadata of the fields that it reads."""
    w = facts.statements.filter("category in ('projection_write', 'conditional_write')")
    kinds = lambda df, name: df.groupBy("task", "stmt", "type").count().groupBy("task", "stmt").agg(F.sort_array(F.collect_list(F.struct("type", "count"))).alias(name))
    parts = [
        _list(facts.scopes, "scopes", "scope", "kind", "role", "is_distinct", "set_op"), _list(facts.scope_edges, "scope_edges", "upstream", "downstream"),
        _list(facts.columns, "columns", "scope", "ord", "column", "transform", "expression", "expanded_type", "role", "grain_effect"),
        _list(facts.column_sources, "column_sources", "scope", "column", "ord", "src_scope", "src_column", "role"),
        _list(facts.joins, "joins", "scope", "ord", "join_type", "condition", "status"), _list(facts.predicates, "filters", "scope", "ord", "kind", "expression"),
        _list(end_to_end(facts), "end_to_end", "column", "source_kind", "trace_complete", "physical", "rowsets", "generated", "reasons"),
        _list(chains(facts), "chains", "chain", "step_no", "target", "scope", "column", "expression", "expanded"),
        _list(facts.warnings, "warnings", "scope", "type", "detail"), _list(gaps(facts), "gaps", "gap", "type", "bucket", "column"),
        kinds(facts.warnings.unionByName(gaps(facts).select("task", "stmt", "scope", "type", F.col("column").alias("detail"))), "diagnostics"),
    ]
    body = ["scopes", "scope_edges", "columns", "column_sources", "joins", "filters", "end_to_end", "chains", "warnings", "gaps", "diagnostics"]
    if columns is not None:
        used = facts.column_sources.join(facts.inputs.filter("source_type = 'table'").select("task", "stmt", F.col("source").alias("src_scope")).distinct(), ["task", "stmt", "src_scope"])
        used = used.select("task", "stmt", F.col("src_scope").alias("relation"), F.lower("src_column").alias("column")).distinct()
        known = columns.select(F.col("relation").alias("_r"), F.col("column").alias("_c"), "type", "comment")
        told = used.join(known, (F.lower("relation") == F.col("_r")) & (F.col("column") == F.col("_c")), "left")
        parts.append(_list(told, "column_details", "relation", "column", "type", "comment"))
        body.append("column_details")
    for p in parts:
        w = w.join(p, ["task", "stmt"], "left")
    fields = [F.lit(VERSION_1).alias("schema_version"), "task", "stmt", F.col("kind").alias("stmt_kind"), F.col("target").alias("target_table"), "parse_status", "syntax_status", "partition_mode", "partition_spec"]
    return w.select("task", "stmt", F.struct(*fields, *body).alias("body"))


def statement_documents(facts: Facts, columns: DataFrame | None = None, compact: bool = True) -> DataFrame:
    """``(task, stmt, document)``: one JSON document for each write statement; equal content with and without white space."""
    return _bodies(facts, columns).select("task", "stmt", _text(F.col("body"), compact).alias("document"))


def task_documents(facts: Facts, columns: DataFrame | None = None, compact: bool = True) -> DataFrame:
    """``(task, document)``: one JSON document for each script, with its statements in order, each write's own document inside, and its table states."""
    st = facts.statements.join(_bodies(facts, columns), ["task", "stmt"], "left")
    every = st.groupBy("task").agg(F.array_sort(F.collect_list(F.struct("idx", "stmt", "kind", "target", "category", "model_status", "syntax_status", F.to_json("body").alias("_body")))).alias("_rows"))
    made = states(facts).groupBy("task").agg(F.sort_array(F.collect_list(F.struct("write_ordinal", "state", "relation", "effect", "previous", "session_scoped", "is_final"))).alias("states"))
    kind = _bodies(facts, columns).schema["body"].dataType
    rows = F.transform("_rows", lambda r: F.struct(*[r[c].alias(c) for c in ("idx", "stmt", "kind", "target", "category", "model_status", "syntax_status")], F.from_json(r["_body"], kind).alias("document")))
    return every.join(made, "task", "left").select("task", _text(F.struct(F.lit(VERSION_2).alias("schema_version"), "task", rows.alias("statements"), "states"), compact).alias("document"))


def diagnostics_documents(facts: Facts, compact: bool = True) -> DataFrame:
    """``(task, document)``: all warnings, gaps and counts of a script, in one order whatever the run."""
    warned = facts.warnings.groupBy("task").agg(F.sort_array(F.collect_list(F.struct("stmt", "scope", "type", "detail"))).alias("warnings"))
    open_ = gaps(facts).groupBy("task").agg(F.sort_array(F.collect_list(F.struct("gap", "stmt", "scope", "column", "type", "bucket", "sub_bucket", "owner_hint", "reason", "root_impact", "recovered"))).alias("gaps"))
    counts = statistics(facts)
    counted = counts.groupBy("task").agg(F.sort_array(F.collect_list(F.struct("stmt", *[c for c in counts.columns if c.startswith("n_") or c == "depth"]))).alias("statistics"))
    every = facts.statements.select("task").distinct().join(warned, "task", "left").join(open_, "task", "left").join(counted, "task", "left")
    return every.select("task", _text(F.struct(F.lit(VERSION_1).alias("schema_version"), "task", "warnings", "gaps", "statistics"), compact).alias("document"))


#: Closed vocabularies of further fact tables.
VOCABULARIES = {
    ("scopes", "kind"): "cte root subquery udtf union union_branch".split(),
    ("scopes", "role"): "aggregate dedup filter join label pass_through transform union union_branch".split(),
    ("columns", "transform"): "AGGREGATE CONDITIONAL CONSTANT DIRECT EXPAND_ALL EXPRESSION UNION WINDOW".split(),
    ("columns", "grain_effect"): "changed preserved unknown".split(),
    ("column_sources", "role"): "candidate filter order partition value".split(),
    ("joins", "status"): "complete partial".split(),
    ("join_keys", "origin"): "on using where_filter".split(),
    ("inputs", "source_type"): "scope table values".split(),
}


def violations(facts: Facts) -> DataFrame:
    """Values outside the closed vocabularies, broken references, and modelled writes without a block: ``(task, stmt, problem, name)``."""
    out = cross_references(facts)
    for column, allowed in ENUMS.items():
        out = out.union(facts.statements.filter(~F.col(column).isin(allowed)).select("task", "stmt", F.lit(f"unknown_{column}"), column))
    for (table, column), allowed in VOCABULARIES.items():
        out = out.union(getattr(facts, table).filter(~F.col(column).isin(allowed)).select("task", "stmt", F.lit(f"unknown_{table}_{column}"), column))
    bare = facts.statements.filter("category in ('projection_write', 'conditional_write')").join(facts.scopes.select("task", "stmt"), ["task", "stmt"], "left_anti")
    return out.union(bare.select("task", "stmt", F.lit("write_without_blocks"), "target"))


def write(facts: Facts, folder: str, columns: DataFrame | None = None, compact: bool = True) -> None:
    """Check, then write every fact table as Parquet and the documents as JSON, compact ones one a line; invalid facts write nothing."""
    broken = violations(facts).take(5)
    if broken:
        raise InvalidFacts("; ".join(f"{r.task} {r.stmt}: {r.problem} {r.name}" for r in broken))
    for name, df in facts.tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/facts/{name}")
    for name, documents in (("lineage", statement_documents(facts, columns, compact)), ("task_lineage", task_documents(facts, columns, compact)), ("diagnostics", diagnostics_documents(facts, compact))):
        documents.select("document").write.mode("overwrite").text(f"{folder}/{name}")


def _lines(df: DataFrame, section: int, line: Column, *order: str) -> DataFrame:
    return df.select("task", "stmt", F.lit(section).alias("section"), F.concat_ws("|", *[F.lpad(F.col(o).cast("string"), 40, " ") for o in order]).alias("place"), line.alias("line"))


def mapping_markdown(facts: Facts) -> DataFrame:
    """``(task, stmt, markdown)``: target, sources, mapping, steps, logic, graph, statistics and gaps of each write."""
    w = facts.statements.filter("category in ('projection_write', 'conditional_write')").select("task", "stmt", "kind", "target", "parse_status", "syntax_status", "partition_mode")
    head = lambda n, title: _lines(w.withColumn("o", F.lit("")), n, F.lit(f"\n## {title}\n"), "o")
    e = end_to_end(facts)
    physical = F.array_join(F.transform("physical", lambda p: F.concat_ws(".", p["source"], p["source_column"])), ", ")
    parts = [
        _lines(w, 0, F.format_string("---\ndoc_format: mapping\nschema_version: 1.0\ntask_name: %s\ntarget_table: %s\nstmt_kind: %s\n---", "task", "target", "kind"), "stmt"),
        head(1, "Overview"), _lines(w, 2, F.format_string("- parse: %s, syntax: %s, partitions: %s", "parse_status", "syntax_status", "partition_mode"), "stmt"),
        head(3, "Sources"), _lines(facts.inputs.filter("source_type = 'table'").select("task", "stmt", "source").distinct(), 4, F.format_string("- %s", "source"), "source"),
        head(5, "Mapping"), _lines(e, 6, F.concat(F.lit("- "), F.col("column"), F.lit(" <- "), physical, F.when(F.size("generated") > 0, F.concat(F.lit(" generated: "), F.array_join("generated", ", "))).otherwise(""), F.when(F.col("trace_complete"), "").otherwise(" (incomplete)")), "column"),
        head(7, "Steps"), _lines(mapping_steps(facts), 8, F.format_string("%s %d. %s.%s: %s %s", "target", "step_no", "scope", "column", "transform", "expression"), "target", "step_no"),
        head(9, "Logic"), _lines(facts.predicates, 10, F.format_string("- %s %s: %s", "scope", "kind", "expression"), "scope", "ord"), _lines(facts.joins, 11, F.format_string("- %s %s: %s", "scope", "join_type", F.coalesce("condition", F.lit("-"))), "scope", "ord"),
        head(12, "Graph"), _lines(facts.scope_edges, 13, F.format_string("- %s -> %s", "upstream", "downstream"), "upstream", "downstream"),
        head(14, "Profile"), _lines(scope_order(facts).join(facts.scopes.select("task", "stmt", "scope", "role"), ["task", "stmt", "scope"]), 15, F.format_string("- level %d %s: %s", "level", "scope", "role"), "level", "scope"),
        head(16, "Gaps"), _lines(gaps(facts), 17, F.format_string("- %s %s: %s", "gap", "type", "column"), "gap"),
    ]
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    text = every.join(w.select("task", "stmt"), ["task", "stmt"], "left_semi").groupBy("task", "stmt").agg(F.sort_array(F.collect_list(F.struct("section", "place", "line"))).alias("lines"))
    return text.select("task", "stmt", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("markdown"))


def warnings_markdown(facts: Facts) -> DataFrame:
    """``(task, markdown)``: warnings by type; a script without any has no row."""
    line = F.format_string("- %s %s: %s", "stmt", "scope", "detail")
    by = facts.warnings.groupBy("task", "type").agg(F.sort_array(F.collect_list(line)).alias("lines"))
    block = F.concat(F.lit("## "), F.col("type"), F.lit("\n"), F.array_join("lines", "\n"))
    return by.groupBy("task").agg(F.array_join(F.sort_array(F.collect_list(block)), "\n\n").alias("markdown"))


def profile(facts: Facts) -> DataFrame:
    """Ordered steps of each statement with what each does: ``(task, stmt, level, scope, kind, role, n_columns)``."""
    n = facts.columns.groupBy("task", "stmt", "scope").agg(F.count("*").alias("n_columns"))
    return scope_order(facts).join(facts.scopes.select("task", "stmt", "scope", "kind", "role"), ["task", "stmt", "scope"]).join(n, ["task", "stmt", "scope"], "left").na.fill(0)


__all__ = ["InvalidFacts", "diagnostics_documents", "mapping_markdown", "profile", "relations", "statement_documents", "statistics", "task_documents", "violations", "warnings_markdown", "write"]

"""Questions over the fact tables: usage, logic blocks, statistics, gaps, cross-references, binding and the quality gate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtrace.operators.links import physical_join_keys, target_reach
from loomtrace.operators.trace import end_to_end, scope_order
from loomtrace.plans.facts import Facts

KEY = ["task", "stmt", "scope"]
#: Stands for the keys of a join whose condition has no equality between its inputs.
NO_KEY = "no equality key"


def field_usage(facts: Facts) -> DataFrame:
    """``(task, stmt, source, field, used_by)``: where each input field is used, as a sorted set."""
    def use(df: DataFrame, by: Column) -> DataFrame:
        return df.select("task", "stmt", F.col("src_scope").alias("source"), F.col("src_column").alias("field"), by.alias("by"))

    alias = facts.inputs.select(*KEY, "alias", "source")
    keys = facts.join_keys
    sides = [keys.select(*KEY, F.col(f"{s}_alias").alias("alias"), F.col(f"{s}_column").alias("field")) for s in ("left", "right")]
    joined = sides[0].union(sides[1]).join(alias, [*KEY, "alias"]).select("task", "stmt", "source", "field", F.lit("join").alias("by"))
    parts = [
        use(facts.column_sources.filter("role in ('value', 'candidate')"), F.lit("output")),
        use(facts.column_sources.filter("role in ('partition', 'order')"), F.lit("window")),
        use(facts.predicate_fields, F.when(F.col("kind") == "having", "having").when(F.col("kind") == "join_on", "join").otherwise("filter")),
        use(facts.groupings, F.lit("group_by")),
        use(facts.orders, F.lit("order_by")),
        joined,
    ]
    every = reduce(DataFrame.union, parts).filter("source not in ('CONSTANT', 'SYSTEM', 'UNKNOWN', 'AMBIGUOUS')")
    return every.groupBy("task", "stmt", "source", "field").agg(F.array_join(F.sort_array(F.collect_set("by")), ",").alias("used_by"))


def logic_blocks(facts: Facts) -> DataFrame:
    """``(task, stmt, scope, block, type, expression, fingerprint, status)``; blocks are numbered by scope and type."""
    def block(df: DataFrame, kind: str | Column, text: Column, ord_: Column, status: Column | None = None) -> DataFrame:
        kind = F.lit(kind) if isinstance(kind, str) else kind
        return df.select(*KEY, kind.alias("type"), text.alias("expression"), ord_.alias("ord"), (status if status is not None else F.lit("complete")).alias("status"))

    c = facts.columns
    parts = [
        block(facts.joins, "join", F.concat_ws(" ", "join_type", "left_inputs", "right_inputs", "condition"), F.col("ord"), F.col("status")),
        block(facts.predicates.filter("kind not in ('having', 'join_on')"), "filter", F.col("expression"), F.col("ord")),
        block(facts.predicates.filter("kind = 'having'"), "having", F.col("expression"), F.col("ord")),
        block(facts.groupings.select(*KEY, "ord", "expression").distinct(), "group_by", F.col("expression"), F.col("ord")),
        block(facts.scopes.filter("is_distinct"), "distinct", F.col("scope"), F.lit(0)),
        block(c.filter("transform = 'CONDITIONAL'"), "case_when", F.col("expression"), F.col("ord")),
        block(c.filter("transform = 'WINDOW'"), "window", F.col("expression"), F.col("ord")),
        block(c.filter("transform = 'AGGREGATE'"), "aggregate", F.col("expression"), F.col("ord")),
        block(c.filter("transform = 'UNION'"), "union", F.col("expression"), F.col("ord")),
    ]
    every = reduce(DataFrame.union, parts)
    number = F.row_number().over(Window.partitionBy(*KEY, "type").orderBy("ord", "expression"))
    normal = F.lower(F.regexp_replace(F.trim("expression"), r"\s+", " "))
    return every.select(*KEY, F.format_string("logic:%s:%s:%03d", F.col("scope"), F.col("type"), number).alias("block"), "type", "expression", F.concat_ws(":", "type", normal).alias("fingerprint"), "status")


def statistics(facts: Facts) -> DataFrame:
    """Counts of each statement: scopes, inputs, columns, joins, predicates, aggregates, windows, cases, warnings and the depth of its scope graph."""
    base = facts.statements.select("task", "stmt", "kind", "target")
    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("task", "stmt").agg(F.count("*").alias(name))

    parts = [
        counted(facts.scopes, "n_scopes"), counted(facts.inputs.filter("source_type = 'table'"), "n_tables"), counted(facts.columns, "n_columns"), counted(facts.joins, "n_joins"), counted(facts.predicates, "n_predicates"),
        counted(facts.columns.filter("aggregate is not null"), "n_aggregates"), counted(facts.columns.filter("transform = 'WINDOW'"), "n_windows"), counted(facts.columns.filter("transform = 'CONDITIONAL'"), "n_cases"), counted(facts.warnings, "n_warnings"),
        scope_order(facts).groupBy("task", "stmt").agg((F.max("level") + 1).alias("depth")),
    ]
    wide = reduce(lambda a, b: a.join(b, ["task", "stmt"], "left"), parts, base)
    return wide.na.fill(0)


def gaps(facts: Facts) -> DataFrame:
    """``(task, stmt, gap, type, bucket, sub_bucket, owner_hint, scope, column, reason, root_impact, recovered)`` of what could not be traced.

    Outputs of a write whose trace is not complete have ``root_impact``; so has nothing else: an output of an inner block that
    is open and reaches no target is a gap without it.  ``recovered`` marks gaps of statements whose syntax was recovered,
    which may only be its effect.
    """
    root = end_to_end(facts).filter("not trace_complete").select("task", "stmt", F.lit("ROOT").alias("scope"), "column", F.explode("reasons").alias("reason"), F.lit(True).alias("root_impact"))
    named = F.when(F.col("src_scope") == "AMBIGUOUS", "ambiguous_unqualified").when(F.col("src_scope") == "UNKNOWN", "unknown_source").when((F.col("src_column") == "*") & (F.col("transform") == "EXPAND_ALL"), "star_not_expanded")
    local = facts.column_sources.filter("scope not like 'ROOT%'").select(*KEY, "column", named.alias("reason")).filter("reason is not null").distinct()
    inner = local.join(target_reach(facts).select(*KEY, "column").distinct(), [*KEY, "column"], "left_anti").withColumn("root_impact", F.lit(False))
    open_ = root.unionByName(inner)
    reason = F.col("reason")
    kind = (
        F.when(reason == "star_not_expanded", "projection_wildcard_unexpanded").when(reason == "missing_scope_column", "scope_output_mapping_missing")
        .when(reason == "ambiguous_unqualified", "expression_source_unresolved").when(reason == "unknown_source", "alias_binding_missing").otherwise("expression_resolution_incomplete")
    )
    bucket = (
        F.when(reason == "star_not_expanded", "wildcard_projection").when(reason == "missing_scope_column", "upstream_output_mapping").when(reason == "ambiguous_unqualified", "bare_unqualified_field")
        .when(reason == "unknown_source", "alias_binding").otherwise("other_expression_unresolved")
    )
    joined = facts.joins.select(*KEY).distinct().withColumn("joins", F.lit(True))
    sub = F.when(reason == "ambiguous_unqualified", F.when(F.col("joins"), "join_without_metadata").otherwise("single_input")).when(reason == "star_not_expanded", "metadata_missing").when(reason == "cycle_detected", "recursion").otherwise("name_not_found")
    owner = F.when(reason.isin("star_not_expanded", "ambiguous_unqualified"), "metadata").when(reason.isin("unknown_source", "missing_scope_column"), "sql").otherwise("parser")
    number = F.row_number().over(Window.partitionBy("task").orderBy("stmt", F.desc("root_impact"), "scope", "column", "reason"))
    recovered = facts.statements.select("task", "stmt", (F.col("syntax_status") == "recovered").alias("recovered"))
    return open_.join(joined, KEY, "left").join(recovered, ["task", "stmt"]).select("task", "stmt", F.format_string("lineage_gap:%04d", number).alias("gap"), kind.alias("type"), bucket.alias("bucket"), sub.alias("sub_bucket"), owner.alias("owner_hint"), "scope", "column", "reason", "root_impact", "recovered")


def cross_references(facts: Facts) -> DataFrame:
    """Broken references and repeated names: ``(task, stmt, problem, name)``; empty where the documents are sound."""
    scopes = facts.scopes.select("task", "stmt", "scope")
    asked = facts.inputs.filter("source_type = 'scope'").select("task", "stmt", F.col("source").alias("scope"))
    edge = facts.scope_edges.select("task", "stmt", F.col("upstream").alias("scope")).union(facts.scope_edges.select("task", "stmt", F.col("downstream").alias("scope")))
    missing = asked.union(edge).distinct().join(scopes, KEY, "left_anti").select("task", "stmt", F.lit("unknown_scope").alias("problem"), F.col("scope").alias("name"))
    twice = scopes.groupBy(*KEY).count().filter("count > 1").select("task", "stmt", F.lit("duplicate_scope"), "scope")
    statements = facts.statements.groupBy("task", "stmt").count().filter("count > 1").select("task", "stmt", F.lit("duplicate_statement"), "stmt")
    orphans = facts.columns.select(*KEY).distinct().join(scopes, KEY, "left_anti").select("task", "stmt", F.lit("orphan_columns"), "scope")
    return missing.union(twice).union(statements).union(orphans)


def source_coverage(facts: Facts, declared: DataFrame) -> DataFrame:
    """``(task, source, status)``: tables both declared and read, only declared, or only read.  ``declared``: (task, source)."""
    read = facts.inputs.filter("source_type = 'table'").select("task", F.lower("source").alias("source"), F.lit(1).alias("r")).distinct()
    said = declared.select("task", F.lower("source").alias("source"), F.lit(1).alias("d")).distinct()
    status = F.when(F.col("r").isNull(), "declared_not_read").when(F.col("d").isNull(), "read_not_declared").otherwise("covered")
    return read.join(said, ["task", "source"], "full").select("task", "source", status.alias("status"))


def raw_quality(facts: Facts) -> DataFrame:
    """Placeholders left in the SQL text: ``(task, stmt, marks)``."""
    marks = F.regexp_extract_all("sql", F.lit(r"(?i)\b(TODO|FIXME|xxx+)\b|\?\?\?"), F.lit(0))
    return facts.statements.select("task", "stmt", F.array_join(F.sort_array(F.array_distinct(F.transform(marks, lambda m: F.upper(m)))), ",").alias("marks")).filter("marks <> ''")


def target_binding(facts: Facts, target_columns: DataFrame) -> DataFrame:
    """``(task, stmt, target, ordinal, parsed_name, target_column, status)`` of every projection write.

    Outputs are matched by position with the columns that the INSERT lists, or else with the target's columns, static
    partition columns left out; a count that differs or a column listed twice leaves all names of the statement as parsed
    (``fallback``).  Outputs of INSERT BY NAME are named as their targets (``not_applied``); a target without metadata is
    ``metadata_not_provided`` and keeps names as parsed, listed columns or not.
    ``target_columns``: (relation, ordinal, column); relations are compared by their last two name parts.
    """
    relation = lambda c: F.regexp_extract(F.lower(c), r"([^.]*\.)?[^.]*$", 0)
    w = facts.statements.filter("kind in ('INSERT', 'INSERT_OVERWRITE')").select("task", "stmt", "target", relation("target").alias("relation"), "partition_spec", "insert_columns", "by_name")
    fixed = F.map_keys(F.map_filter("partition_spec", lambda k, v: v.isNotNull()))
    known = w.join(target_columns.select(relation("relation").alias("relation"), "ordinal", F.col("column").alias("target_column")), "relation").withColumn("listed", F.coalesce(F.size("insert_columns"), F.lit(0)) > 0)
    place = F.row_number().over(Window.partitionBy("task", "stmt").orderBy("ordinal")) - 1
    by_table = known.filter(~F.col("listed")).withColumn("fixed", fixed).filter(~F.array_contains("fixed", F.col("target_column"))).select("task", "stmt", place.alias("ord"), "target_column")
    by_list = known.filter("listed").select("task", "stmt", "insert_columns").distinct().select("task", "stmt", F.posexplode("insert_columns").alias("ord", "target_column"))
    each = Window.partitionBy("task", "stmt")
    wanted = by_table.unionByName(by_list).select("*", F.count("*").over(each).alias("n_target"))
    doubled = by_list.groupBy("task", "stmt", F.lower("target_column")).count().filter("count > 1").select("task", "stmt", F.lit(True).alias("doubled")).distinct()
    roots = facts.columns.filter("scope like 'ROOT%'").select("task", "stmt", "ord", F.col("column").alias("parsed_name"), F.count("*").over(each).alias("n_out"))
    got = w.join(roots, ["task", "stmt"]).join(wanted.select("task", "stmt", "n_target").distinct(), ["task", "stmt"], "left").join(wanted.drop("n_target"), ["task", "stmt", "ord"], "left").join(doubled, ["task", "stmt"], "left")
    status = (
        F.when(F.col("n_target").isNull(), "metadata_not_provided").when(F.col("by_name"), "not_applied")
        .when((F.col("n_target") != F.col("n_out")) | F.col("doubled").isNotNull(), "fallback").otherwise("applied")
    )
    return got.select("task", "stmt", "target", F.col("ord").alias("ordinal"), "parsed_name", F.when(status == "applied", F.col("target_column")).otherwise(F.col("parsed_name")).alias("target_column"), status.alias("status"))


def relations(facts: Facts) -> DataFrame:
    """Joined pairs of physical tables with how often: ``(left_table, join_type, right_table, keys, n)``.

    Keys are traced through CTEs, derived tables and set operations to physical fields; a key with several on a side
    gives all their pairs, one that comes back to the same field on both sides, or to none, gives no pair.  A join
    without keys stays with ``NO_KEY`` where its first inputs are tables; equalities in WHERE are predicates, not keys.
    """
    pairs = physical_join_keys(facts).filter("origin <> 'where_filter' and not (left_table = right_table and lower(left_field) = lower(right_field))").join(facts.joins.select(*KEY, "ord", "join_type"), [*KEY, "ord"])
    one = pairs.groupBy(*KEY, "ord", "left_table", "join_type", "right_table").agg(F.array_join(F.sort_array(F.collect_set(F.concat_ws("=", "left_field", "right_field"))), ",").alias("keys"))
    first = lambda s: facts.inputs.filter("source_type = 'table'").select(*KEY, F.col("alias").alias(f"{s}_alias"), F.col("source").alias(f"{s}_table"))
    bare = facts.joins.join(facts.join_keys.filter("origin <> 'where_filter'"), [*KEY, "ord"], "left_anti").select(*KEY, "ord", "join_type", *[F.substring_index(f"{s}_inputs", ",", 1).alias(f"{s}_alias") for s in ("left", "right")])
    bare = bare.join(first("left"), [*KEY, "left_alias"]).join(first("right"), [*KEY, "right_alias"]).select(*KEY, "ord", "left_table", "join_type", "right_table", F.lit(NO_KEY).alias("keys"))
    return one.unionByName(bare).groupBy("left_table", "join_type", "right_table", "keys").agg(F.count("*").alias("n"))


def quality_gate(facts: Facts, level: str = "balanced", target_columns: DataFrame | None = None) -> DataFrame:
    """``(task, failures, passed)``: permissive lets all pass; balanced fails on unsupported or failed statements; strict also on gaps, recovered syntax, open stars in outputs and, by ``target_columns`` as in ``target_binding``, on writes that don't fit their target."""
    if level not in ("permissive", "balanced", "strict"):
        raise ValueError("level is permissive, balanced or strict")
    st = facts.statements
    bad = st.filter("model_status in ('unsupported', 'failed')").select("task", F.lit("statement_not_modeled").alias("failure"))
    if level == "strict":
        bad = bad.union(gaps(facts).filter("root_impact").select("task", F.lit("root_gap"))).union(st.filter("syntax_status = 'recovered'").select("task", F.lit("recovered_syntax")))
        if target_columns is not None:
            bad = bad.union(target_binding(facts, target_columns).filter("status = 'fallback'").select("task", F.lit("binding_fallback")))
    if level == "permissive":
        bad = bad.limit(0)
    found = bad.groupBy("task").agg(F.array_join(F.sort_array(F.collect_set("failure")), ",").alias("failures"))
    return st.select("task").distinct().join(found, "task", "left").select("task", F.coalesce("failures", F.lit("")).alias("failures"), F.col("failures").isNull().alias("passed"))


def upstream_of(closed: DataFrame, table: str) -> DataFrame:
    return closed.filter(F.col("downstream") == table)


def impact_of(closed: DataFrame, table: str) -> DataFrame:
    return closed.filter(F.col("upstream") == table)

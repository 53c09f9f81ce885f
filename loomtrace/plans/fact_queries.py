"""Questions over the facts of the fixed corpus.

Base facts (statements, scopes, inputs, columns, sources) are held against rows that were recorded and then
reviewed against the scripts.  Traces, levels, states, reads and closures are held against SQL that works them out
again from those base facts.  Rows in ``HAND`` were written from the scripts' text, and the output names of the query pack
are those that another engine gives the same statements.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrace.operators import audit, publish, states, trace
from loomtrace.plans import corpus, query_pack
from loomtrace.plans.construct_queries import rows_sql
from loomtrace.plans.corpus_expected import EXPECTED, TABLE_EDGES
from loomtrace.plans.facts import Facts, analyze

_made: dict[str, Facts] = {}
#: Tables of the pack's statements that the corpus does not read.
PACK_SCHEMA = {"embeddings": ["vec_id", "embedding", "label"], "documents": ["doc_id", "text", "lang", "source", "n_chars"], "conversations": ["conv_id", "turn", "role", "text"], "pages": ["page_id", "url", "html"]}


def _facts(spark: SparkSession) -> Facts:
    """The corpus is parsed once in a session."""
    key = spark.sparkContext.applicationId
    if key not in _made:
        _made.clear()
        _made[key] = corpus.facts(spark)
    return _made[key]


def _columns(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t, i, c) for t, cs in corpus.SCHEMA.items() for i, c in enumerate(cs)], "relation string, ordinal int, column string")


def _end_to_end(f: Facts) -> DataFrame:
    names = F.array_join(F.transform("physical", lambda p: F.concat_ws(".", p["source"], p["source_column"])), ",")
    context = F.array_join(F.transform("window_context", lambda p: F.concat_ws(".", p["role"], p["source"], p["source_column"])), ",")
    return trace.end_to_end(f).select("task", "stmt", "column", "source_kind", "trace_complete", names.alias("physical"), F.array_join("rowsets", ",").alias("rowsets"), F.array_join("generated", ",").alias("generated"), context.alias("window_context"), F.array_join("candidates", ",").alias("candidates"), F.array_join("reasons", ",").alias("reasons"))


def _pack_outputs(spark: SparkSession) -> DataFrame:
    """Output names that the analyzer gives each statement of the query pack, from its text alone."""
    f = analyze(spark, [(name, spark_sql) for name, (_, spark_sql, _) in query_pack.PACK.items()], corpus.SCHEMA | PACK_SCHEMA)
    return f.columns.filter("scope = 'ROOT'").select(F.col("task").alias("query"), F.lower("column").alias("column"))


QUERIES: dict[str, Callable[[SparkSession, Facts], DataFrame]] = {
    "q_p2_output_names": lambda s, f: _pack_outputs(s),
    "q_t1_statements": lambda s, f: f.statements.select("task", "stmt", "kind", "target", "category", "model_status", "syntax_status", "partition_mode", "session_scoped", "write_ordinal", "overwrite_mode", "overwrite_mode_source"),
    "q_x1_scope_graph": lambda s, f: f.scope_edges,
    "q_x1_scopes": lambda s, f: f.scopes,
    "q_x2_scope_order": lambda s, f: trace.scope_order(f),
    "q_x3_trace": lambda s, f: trace.sources(f),
    "q_x3_end_to_end": lambda s, f: _end_to_end(f),
    "q_x3_table_closure": lambda s, f: trace.closure(trace.table_edges(f)),
    "q_x1_column_sources": lambda s, f: f.column_sources,
    "q_x9_inputs": lambda s, f: f.inputs,
    "q_x10_expansions": lambda s, f: f.expansions.select("task", "stmt", "scope", "column", "display", "expanded", "status", F.array_join("reasons", ",").alias("reasons"), "substitutions"),
    "q_x16_mapping_steps": lambda s, f: trace.mapping_steps(f),
    "q_x47_chains": lambda s, f: trace.chain_text(f),
    "q_x19_usage": lambda s, f: audit.field_usage(f),
    "q_x20_logic_blocks": lambda s, f: audit.logic_blocks(f),
    "q_x22_coverage": lambda s, f: states.coverage(f, _columns(s)),
    "q_x25_binding": lambda s, f: audit.target_binding(f, _columns(s)),
    "q_x27_gaps": lambda s, f: audit.gaps(f),
    "q_x30_warnings": lambda s, f: f.warnings.withColumn("detail", F.when(F.col("type") == "LINEAGE_ERROR", F.regexp_extract("detail", r"^\[\w+\]", 0)).otherwise(F.col("detail"))),
    "q_x32_statistics": lambda s, f: audit.statistics(f),
    "q_x33_profile": lambda s, f: publish.profile(f),
    "q_x34_states": lambda s, f: states.states(f),
    "q_x35_final_states": lambda s, f: states.final_states(f),
    "q_x38_conditions": lambda s, f: states.conditions(f),
    "q_x39_reads": lambda s, f: states.reads(f),
    "q_x40_fold": lambda s, f: states.fold_sessions(f),
    "q_x42_cross_references": lambda s, f: audit.cross_references(f),
    "q_x45_quality_gate": lambda s, f: audit.quality_gate(f, "strict", _columns(s)),
    "q_j6_join_keys": lambda s, f: f.join_keys,
    "q_j9_relations": lambda s, f: audit.relations(f),
    "q_p9_projection_facts": lambda s, f: f.columns.select("task", "stmt", "scope", "ord", "column", "transform", "expression", "expanded_type", "role", "grain_effect"),
    "q_p18_predicates": lambda s, f: f.predicates,
    "q_a1_groupings": lambda s, f: f.groupings,
    "q_w4_window_context": lambda s, f: f.column_sources.filter("role in ('partition', 'order')").select("task", "stmt", "scope", "column", "src_scope", "src_column", "role"),
}

_CLOSURE = f"""
    WITH RECURSIVE e AS (SELECT * FROM (VALUES {TABLE_EDGES}) v(u, d)),
    c(u, d, n) AS (SELECT u, d, 1 FROM e WHERE u <> d UNION SELECT c.u, e.d, c.n + 1 FROM c JOIN e ON c.d = e.u WHERE c.n < 20)
    SELECT u AS upstream, d AS downstream, CAST(min(n) AS INTEGER) AS distance FROM c WHERE u <> d GROUP BY u, d"""


_BASE = {k: f"({EXPECTED.get(k, 'SELECT 1')})" for k in ("q_t1_statements", "q_x1_scope_graph", "q_x1_scopes", "q_x1_column_sources", "q_x9_inputs")}
_RANKS = "list_position(['CONSTANT', 'DIRECT', 'EXPAND_ALL', 'UNION', 'EXPRESSION', 'CONDITIONAL', 'WINDOW', 'AGGREGATE'], {})"
_TRACE = f"""
    WITH RECURSIVE cs AS {_BASE["q_x1_column_sources"]}, sc AS {_BASE["q_x1_scopes"]},
    w AS (
        SELECT DISTINCT task, stmt, "column" AS target, scope, "column" AS col, 0 AS rank, 'value' AS role, -1 AS hops FROM cs WHERE scope LIKE 'ROOT%'
        UNION
        SELECT w.task, w.stmt, w.target, cs.src_scope, cs.src_column, greatest(w.rank, {_RANKS.format("cs.transform")}), CASE cs.role WHEN 'value' THEN w.role ELSE cs.role END, w.hops + 1
        FROM w JOIN cs ON cs.task = w.task AND cs.stmt = w.stmt AND cs.scope = w.scope AND cs."column" = w.col),
    e AS (SELECT w.* FROM w ANTI JOIN sc ON sc.task = w.task AND sc.stmt = w.stmt AND sc.scope = w.scope),
    k AS (SELECT *, CASE WHEN scope IN ('CONSTANT', 'SYSTEM') THEN 'generated' WHEN scope IN ('AMBIGUOUS', 'UNKNOWN') THEN 'unresolved' WHEN col = '*' AND rank >= 7 THEN 'rowset' WHEN col = '*' THEN 'unresolved' ELSE 'physical' END AS source_kind FROM e)
    SELECT task, stmt, target AS "column", source_kind,
        CASE WHEN scope = 'AMBIGUOUS' THEN 'ambiguous_unqualified' WHEN scope = 'UNKNOWN' THEN 'unknown_source' WHEN source_kind = 'unresolved' THEN 'star_not_expanded' ELSE scope END AS source,
        CASE WHEN source_kind = 'unresolved' AND col = '*' THEN scope ELSE col END AS source_column,
        list_extract(['CONSTANT', 'DIRECT', 'EXPAND_ALL', 'UNION', 'EXPRESSION', 'CONDITIONAL', 'WINDOW', 'AGGREGATE'], max(rank)) AS transform, role, CAST(min(hops) AS INTEGER) AS hops
    FROM k GROUP BY task, stmt, target, source_kind, scope, col, role"""
_ORDER = f"""
    WITH RECURSIVE e AS {_BASE["q_x1_scope_graph"]}, sc AS {_BASE["q_x1_scopes"]},
    p AS (SELECT task, stmt, scope, 0 AS n FROM sc UNION SELECT e.task, e.stmt, e.downstream, p.n + 1 FROM p JOIN e ON e.task = p.task AND e.stmt = p.stmt AND e.upstream = p.scope)
    SELECT task, stmt, scope, CAST(max(n) AS INTEGER) AS level FROM p GROUP BY ALL"""
_STATES = f"""
    WITH w AS (SELECT *, lower(target) AS relation FROM {_BASE["q_t1_statements"]} q WHERE write_ordinal IS NOT NULL),
    o AS (SELECT *, row_number() OVER (PARTITION BY task, relation ORDER BY write_ordinal) AS n, count(*) OVER (PARTITION BY task, relation) AS total, bool_or(session_scoped) OVER (PARTITION BY task, relation) AS temporary,
        CASE kind WHEN 'INSERT' THEN 'APPEND' WHEN 'CTAS' THEN 'REPLACE' WHEN 'MERGE' THEN 'MERGE' WHEN 'UPDATE' THEN 'CONDITIONAL_UPDATE' WHEN 'DELETE' THEN 'ANTI_FILTER' WHEN 'TRUNCATE' THEN 'RESET'
            ELSE CASE partition_mode WHEN 'none' THEN 'REPLACE' ELSE 'REPLACE_PARTITION' END END AS effect FROM w),
    s AS (SELECT task, format('state:{{}}:{{:03d}}', relation, n) AS state, relation, CAST(n AS INTEGER) AS ordinal, stmt, write_ordinal, effect,
        CASE WHEN n > 1 AND effect NOT IN ('REPLACE', 'RESET') THEN format('state:{{}}:{{:03d}}', relation, n - 1) END AS previous, temporary AS session_scoped, n = total AS is_final, overwrite_mode, overwrite_mode_source FROM o)"""
_READS = f"""{_STATES},
    r AS (SELECT DISTINCT i.task, i.stmt, lower(i.source) AS source, t.write_ordinal FROM {_BASE["q_x9_inputs"]} i JOIN {_BASE["q_t1_statements"]} t ON i.task = t.task AND i.stmt = t.stmt WHERE i.source_type = 'table' AND t.write_ordinal IS NOT NULL)
    SELECT task, stmt, source, (SELECT arg_max(s.state, s.write_ordinal) FROM s WHERE s.task = r.task AND s.relation = r.source AND s.write_ordinal < r.write_ordinal) AS source_state FROM r"""
RECOMPUTED = {
    "q_x3_table_closure": _CLOSURE,
    "q_x3_trace": _TRACE,
    "q_x2_scope_order": _ORDER,
    "q_x34_states": f"{_STATES} SELECT * FROM s",
    "q_x35_final_states": f"{_STATES} SELECT task, relation, state, effect FROM s WHERE is_final AND NOT session_scoped",
    "q_x39_reads": _READS,
}


#: Rows written by hand from the scripts.
HAND = {
    "q_j6_join_keys": rows_sql(
        "task VARCHAR, stmt VARCHAR, scope VARCHAR, ord INTEGER, left_alias VARCHAR, left_column VARCHAR, right_alias VARCHAR, right_column VARCHAR, origin VARCHAR",
        ("revenue", "stmt:001", "ROOT", 0, "p", "l_orderkey", "o", "o_orderkey", "on"), ("revenue", "stmt:001", "ROOT", 1, "o", "o_custkey", "c", "c_custkey", "on"),
        ("daily", "stmt:005", "ROOT", 0, "c", "c_custkey", "t", "k", "on"), ("upkeep", "stmt:006", "ROOT", 0, "x", "id", "y", "id", "on"),
    ),
    "q_j9_relations": rows_sql(
        "left_table VARCHAR, join_type VARCHAR, right_table VARCHAR, keys VARCHAR, n BIGINT",
        ("lineitem", "INNER", "orders", "l_orderkey=o_orderkey", 1), ("orders", "INNER", "customer", "o_custkey=c_custkey", 1), ("customer", "LEFT_OUTER", "counted", "c_custkey=k", 1), ("somewhere", "INNER", "elsewhere", "id=id", 1),
    ),
    "q_x27_gaps": rows_sql(
        "task VARCHAR, stmt VARCHAR, gap VARCHAR, type VARCHAR, bucket VARCHAR, sub_bucket VARCHAR, owner_hint VARCHAR, scope VARCHAR, column VARCHAR, reason VARCHAR, root_impact BOOLEAN, recovered BOOLEAN",
        ("upkeep", "stmt:006", "lineage_gap:0001", "expression_source_unresolved", "bare_unqualified_field", "join_without_metadata", "metadata", "ROOT", "name", "ambiguous_unqualified", True, False),
        ("upkeep", "stmt:007", "lineage_gap:0002", "projection_wildcard_unexpanded", "wildcard_projection", "metadata_missing", "metadata", "ROOT", "*", "star_not_expanded", True, False),
    ),
    "q_x30_warnings": rows_sql(
        "task VARCHAR, stmt VARCHAR, scope VARCHAR, type VARCHAR, detail VARCHAR",
        ("upkeep", "stmt:001", "ROOT", "merge_delete_ignored", "matched:0"), ("upkeep", "stmt:006", "ROOT", "ambiguous_unqualified", "name"), ("upkeep", "stmt:007", "ROOT", "star_not_expanded", "somewhere"),
        ("upkeep", "stmt:008", "ROOT", "unsupported_statement", "DropTable"), ("upkeep", "stmt:009", "ROOT", "LINEAGE_ERROR", "[PARSE_SYNTAX_ERROR]"),
    ),
}
#: What another engine names the outputs of the pack's statements.
PACK_NAMES = " UNION ALL ".join(f"SELECT '{name}' AS query, lower(column_name) AS \"column\" FROM (DESCRIBE {duck or own})" for name, (_, own, duck) in query_pack.PACK.items())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: (lambda spark, sf_dir, q=q: q(spark, _facts(spark))) for k, q in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return EXPECTED | RECOMPUTED | HAND | {"q_p2_output_names": PACK_NAMES}

"""The analyzer's answers on scripts that hold one construct each, against rows written by hand from the scripts' text.

Nothing here is recorded from a run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrace.operators import audit, links, states, trace
from loomtrace.plans.facts import Facts, analyze

SCHEMA = {"s.t": ["a", "b", "c"], "s.u": ["a", "d"], "s.v": ["b", "e"], "m.w": ["x", "y", "z"]}

SCRIPTS = {
    "joins": """
        INSERT INTO m.j1 SELECT a, b, d FROM s.t FULL JOIN s.u USING (a);
        INSERT INTO m.j2 SELECT a, d FROM s.t NATURAL JOIN s.u;
        INSERT INTO m.j3 SELECT x.c, y.d FROM s.t x, s.u y WHERE x.a = y.a AND y.d > 3;
        INSERT INTO m.j4 WITH p AS (SELECT a AS k, c FROM s.t), q AS (SELECT k AS j FROM p) SELECT q.j, z.d FROM q JOIN (SELECT a AS i, d FROM s.u) z ON q.j = z.i;
        INSERT INTO m.j5 SELECT a, b FROM s.t RIGHT JOIN s.u USING (a)""",
    "rows": """
        INSERT INTO m.r1 WITH RECURSIVE r(n, m) AS (SELECT a, b FROM s.t UNION ALL SELECT m + 1, n FROM r WHERE n < 5) SELECT n, m FROM r;
        INSERT INTO m.r2 SELECT * FROM s.t UNPIVOT (val FOR name IN (a, b));
        INSERT INTO m.r3 SELECT TRANSFORM(a, b) USING 'cat' AS (x, y) FROM s.t;
        INSERT INTO m.r4 FROM s.t |> WHERE a > 1 |> AGGREGATE sum(b) AS s GROUP BY c;
        INSERT INTO m.r5 SELECT id FROM range(10) AS q(id);
        INSERT INTO m.r6 SELECT a FROM s.u VERSION AS OF 3;
        INSERT INTO m.r7 SELECT a, sum(b) AS s FROM s.t GROUP BY ALL;
        INSERT INTO m.r8 SELECT `x, y` AS z FROM s.odd""",
    "logic": """
        INSERT INTO m.l1 SELECT a, CASE WHEN b > 10 THEN 'high' WHEN b > 5 THEN c ELSE 'low' END AS tier, if(c = 'x', 1, 0) AS flag FROM s.t;
        INSERT INTO m.l2 SELECT a, sum(DISTINCT b) AS sb, count(*) AS n, max(c) FILTER (WHERE b > 0) AS mc FROM s.t GROUP BY a HAVING sum(DISTINCT b) > 7;
        INSERT INTO m.l3 SELECT a, c FROM (SELECT a, c, row_number() OVER (PARTITION BY a ORDER BY b DESC) AS rn, sum(b) OVER (PARTITION BY a ORDER BY c ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS run FROM s.t) w WHERE rn = 1;
        INSERT INTO m.l4 SELECT a, b AS x FROM s.t UNION ALL SELECT a, 0 FROM s.u UNION ALL SELECT e FROM s.v;
        INSERT INTO m.l5 SELECT a FROM s.t WHERE b IN (SELECT b FROM s.v WHERE e > 1) AND EXISTS (SELECT 1 FROM s.u WHERE s.u.a = s.t.a);
        INSERT INTO m.l6 SELECT max(struct(b, c)).c AS latest, myudf(a) AS own, cast(a AS string) AS text FROM s.t""",
    "broken": "INSERT INTO m.b1 SELECT a FROM s.t; SELEC 1; INSERT INTO m.b2 SELECT d FROM s.u",
    "writes": """
        INSERT INTO m.w (y, x) SELECT a, b FROM s.t;
        INSERT INTO m.w BY NAME SELECT b AS y, a AS x FROM s.t;
        INSERT OVERWRITE LOCAL DIRECTORY '/tmp/out' USING parquet SELECT a FROM s.t;
        CREATE TABLE m.p PARTITIONED BY (dt) AS SELECT a, c AS dt FROM s.t;
        INSERT INTO m.q REPLACE WHERE a = 1 SELECT a, b FROM s.t;
        INSERT INTO m.w SELECT a FROM s.t""",
    "gaps": """
        INSERT INTO m.g1 SELECT who FROM s.dark1 x JOIN s.dark2 y ON x.id = y.id WHERE WHERE;
        INSERT INTO m.g2 WITH p AS (SELECT a, nowhere FROM s.t) SELECT a FROM p;
        INSERT INTO m.g3 SELECT who FROM s.dark1 x JOIN s.dark2 y ON x.id = y.id""",
}

_made: dict[str, Facts] = {}


def _facts(spark: SparkSession) -> Facts:
    key = spark.sparkContext.applicationId
    if key not in _made:
        _made.clear()
        _made[key] = analyze(spark, SCRIPTS.items(), SCHEMA)
    return _made[key]


def _columns(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t, i, c) for t, cs in SCHEMA.items() for i, c in enumerate(cs)], "relation string, ordinal int, column string")


def _of(df: DataFrame, task: str, *columns: str) -> DataFrame:
    return df.filter(F.col("task") == task).select(F.substring("stmt", -3, 3).alias("stmt"), *columns)


def _trace(f: Facts, task: str) -> DataFrame:
    return _of(trace.sources(f).filter("role = 'value'"), task, "column", "source_kind", "source", "source_column", "transform")


QUERIES: dict[str, Callable[[SparkSession, Facts], DataFrame]] = {
    "q_t19_isolation": lambda s, f: _of(f.statements, "broken", "kind", "parse_status", "target"),
    "q_t2_writes": lambda s, f: _of(f.statements, "writes", "kind", "target", "partition_mode", "by_name", F.array_join("insert_columns", ",").alias("listed"), "target_format"),
    "q_x25_lists_and_names": lambda s, f: _of(audit.target_binding(f, _columns(s)), "writes", "ordinal", "parsed_name", "target_column", "status"),
    "q_j2_merged_columns": lambda s, f: _trace(f, "joins"),
    "q_s21_row_makers": lambda s, f: _trace(f, "rows"),
    "q_j3_mined_keys": lambda s, f: _of(f.join_keys, "joins", "left_alias", "left_column", "right_alias", "right_column", "origin"),
    "q_j8_physical_keys": lambda s, f: _of(links.physical_join_keys(f), "joins", "left_table", "left_field", "right_table", "right_field"),
    "q_a1_group_all": lambda s, f: _of(f.groupings, "rows", "scope", "expression", "src_scope", "src_column"),
    "q_p5_branches": lambda s, f: _of(f.branches, "logic", "column", "ord", "condition", "value"),
    "q_p4_subkinds": lambda s, f: _of(f.columns.filter("subkind is not null and scope = 'ROOT'"), "logic", "column", "transform", "subkind"),
    "q_a3_aggregation": lambda s, f: _of(links.aggregation_detail(f), "logic", "group_items", "aggregate_items", "having", "status"),
    "q_a4_arguments": lambda s, f: _of(f.aggregates, "logic", "column", "function", "argument", "is_distinct", "filter"),
    "q_a8_row_selection": lambda s, f: _of(trace.sources(f).filter("column = 'latest'"), "logic", "source", "source_column", "transform", "role"),
    "q_w3_windows": lambda s, f: _of(links.window_detail(f), "logic", "column", "function", "argument", "partition_by", "order_by", "frame", "status"),
    "q_w5_window_filters": lambda s, f: _of(links.window_filters(f), "logic", "window_scope", "window_column", "filter_scope", "expression"),
    "q_u3_alignment": lambda s, f: _of(links.union_alignment(f), "logic", "ord", "column", "branch", "branch_column", "status"),
    "q_u4_branch_sources": lambda s, f: _of(links.branch_sources(f), "logic", "column", "branch", "source_kind", "source", "source_column"),
    "q_p19_dependencies": lambda s, f: _of(links.predicate_dependencies(f), "logic", "kind", "tables"),
    "q_b11_aliases": lambda s, f: _of(links.alias_bindings(f), "joins", "scope", "alias", "source_type", "tables"),
    "q_b12_bindings": lambda s, f: _of(links.expression_bindings(f), "joins", "scope", "column", "alias", "field"),
    "q_x9_physical_inputs": lambda s, f: _of(links.physical_inputs(f), "joins", "scope", "source"),
    "q_x15_outputs": lambda s, f: _of(links.scope_outputs(f), "joins", "scope", "column", "downstream", "targets"),
    "q_x18_block_targets": lambda s, f: _of(links.block_targets(f), "logic", "scope", "type", "expression", "targets"),
    "q_t20_dropped_writes": lambda s, f: _of(links.first_writes(f)[1], "writes", "type", "detail"),
    "q_x16_chains": lambda s, f: _of(links.chains(f), "joins", "chain", "target", "step_no", "scope", "column"),
    "q_x27_gap_kinds": lambda s, f: _of(audit.gaps(f), "gaps", "type", "sub_bucket", "owner_hint", "scope", "column", "root_impact", "recovered"),
    "q_f8_features": lambda s, f: _of(f.features, "logic", "column", F.array_join("operators", " ").alias("operators"), "has_case", "has_cast", "has_aggregate", "has_window", "has_literal").filter("column in ('tier', 'flag', 'sb', 'mc', 'rn', 'text')"),
    "q_x14_clauses": lambda s, f: _of(f.clauses, "joins", "scope", "kind", "expression", "expanded", "status"),
    "q_x36_effects": lambda s, f: _of(states.states(f), "writes", "relation", "effect"),
}


def rows_sql(columns: str, *rows: tuple) -> str:
    """SQL of rows written by hand; ``columns``: name and type pairs."""
    pairs = [c.split() for c in columns.split(", ")]
    one = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    values = ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)
    names = ", ".join(f'"{n}"' for n, _ in pairs)
    return "SELECT " + ", ".join(f'CAST("{n}" AS {t}) AS "{n}"' for n, t in pairs) + f" FROM (VALUES {values}) v({names})"


_TRACED = "stmt VARCHAR, column VARCHAR, source_kind VARCHAR, source VARCHAR, source_column VARCHAR, transform VARCHAR"
_P = "physical"
ORACLES = {
    "q_t19_isolation": rows_sql("stmt VARCHAR, kind VARCHAR, parse_status VARCHAR, target VARCHAR", ("001", "INSERT", "ok", "m.b1"), ("002", "FAILED", "failed", ""), ("003", "INSERT", "ok", "m.b2")),
    "q_t2_writes": rows_sql(
        "stmt VARCHAR, kind VARCHAR, target VARCHAR, partition_mode VARCHAR, by_name BOOLEAN, listed VARCHAR, target_format VARCHAR",
        ("001", "INSERT", "m.w", "none", False, "y,x", None), ("002", "INSERT", "m.w", "none", True, "", None), ("003", "INSERT_OVERWRITE", "directory:/tmp/out", "none", False, "", "parquet"),
        ("004", "CTAS", "m.p", "dynamic", False, "", None), ("005", "INSERT_OVERWRITE", "m.q", "static", False, "", None), ("006", "INSERT", "m.w", "none", False, "", None),
    ),
    "q_x25_lists_and_names": rows_sql(
        "stmt VARCHAR, ordinal INTEGER, parsed_name VARCHAR, target_column VARCHAR, status VARCHAR",
        ("001", 0, "a", "y", "applied"), ("001", 1, "b", "x", "applied"), ("002", 0, "y", "y", "not_applied"), ("002", 1, "x", "x", "not_applied"),
        ("003", 0, "a", "a", "metadata_not_provided"), ("005", 0, "a", "a", "metadata_not_provided"), ("005", 1, "b", "b", "metadata_not_provided"), ("006", 0, "a", "a", "fallback"),
    ),
    "q_j2_merged_columns": rows_sql(
        _TRACED,
        ("001", "a", _P, "s.t", "a", "EXPRESSION"), ("001", "a", _P, "s.u", "a", "EXPRESSION"), ("001", "b", _P, "s.t", "b", "DIRECT"), ("001", "d", _P, "s.u", "d", "DIRECT"),
        ("002", "a", _P, "s.t", "a", "DIRECT"), ("002", "d", _P, "s.u", "d", "DIRECT"), ("003", "c", _P, "s.t", "c", "DIRECT"), ("003", "d", _P, "s.u", "d", "DIRECT"),
        ("004", "j", _P, "s.t", "a", "DIRECT"), ("004", "d", _P, "s.u", "d", "DIRECT"), ("005", "a", _P, "s.u", "a", "DIRECT"), ("005", "b", _P, "s.t", "b", "DIRECT"),
    ),
    "q_s21_row_makers": rows_sql(
        _TRACED,
        # the second branch swaps the columns, so each comes from both
        ("001", "n", _P, "s.t", "a", "UNION"), ("001", "n", _P, "s.t", "b", "EXPRESSION"), ("001", "m", _P, "s.t", "b", "UNION"), ("001", "m", _P, "s.t", "a", "UNION"),
        ("002", "c", _P, "s.t", "c", "DIRECT"), ("002", "name", "generated", "CONSTANT", "unpivoted names", "DIRECT"), ("002", "val", _P, "s.t", "a", "EXPRESSION"), ("002", "val", _P, "s.t", "b", "EXPRESSION"),
        ("003", "x", _P, "s.t", "a", "EXPRESSION"), ("003", "x", _P, "s.t", "b", "EXPRESSION"), ("003", "y", _P, "s.t", "a", "EXPRESSION"), ("003", "y", _P, "s.t", "b", "EXPRESSION"),
        ("004", "c", _P, "s.t", "c", "DIRECT"), ("004", "s", _P, "s.t", "b", "AGGREGATE"), ("005", "id", "generated", "CONSTANT", "id", "DIRECT"), ("006", "a", _P, "s.u", "a", "DIRECT"),
        ("007", "a", _P, "s.t", "a", "DIRECT"), ("007", "s", _P, "s.t", "b", "AGGREGATE"), ("008", "z", _P, "s.odd", "x, y", "DIRECT"),
    ),
    "q_j3_mined_keys": rows_sql(
        "stmt VARCHAR, left_alias VARCHAR, left_column VARCHAR, right_alias VARCHAR, right_column VARCHAR, origin VARCHAR",
        ("001", "t", "a", "u", "a", "using"), ("002", "t", "a", "u", "a", "using"), ("003", "x", "a", "y", "a", "where_filter"), ("004", "q", "j", "z", "i", "on"), ("005", "t", "a", "u", "a", "using"),
    ),
    "q_j8_physical_keys": rows_sql("stmt VARCHAR, left_table VARCHAR, left_field VARCHAR, right_table VARCHAR, right_field VARCHAR", *[(f"00{n}", "s.t", "a", "s.u", "a") for n in (1, 2, 3, 4, 5)]),
    "q_a1_group_all": rows_sql("stmt VARCHAR, scope VARCHAR, expression VARCHAR, src_scope VARCHAR, src_column VARCHAR", ("004", "ROOT", "c", "s.t", "c"), ("007", "ROOT", "a", "s.t", "a")),
    "q_p5_branches": rows_sql(
        "stmt VARCHAR, column VARCHAR, ord INTEGER, condition VARCHAR, value VARCHAR",
        ("001", "tier", 0, "(b > 10)", "'high'"), ("001", "tier", 1, "(b > 5)", "c"), ("001", "tier", 2, None, "'low'"), ("001", "flag", 0, "(c = 'x')", "1"), ("001", "flag", 1, None, "0"),
    ),
    "q_p4_subkinds": rows_sql(
        "stmt VARCHAR, column VARCHAR, transform VARCHAR, subkind VARCHAR",
        ("001", "tier", "CONDITIONAL", "case_when"), ("001", "flag", "CONDITIONAL", "if"), ("006", "latest", "AGGREGATE", "row_selection"), ("006", "own", "EXPRESSION", "udf"), ("006", "text", "EXPRESSION", "cast"),
    ),
    "q_a3_aggregation": rows_sql(
        "stmt VARCHAR, group_items VARCHAR, aggregate_items VARCHAR, having VARCHAR, status VARCHAR",
        ("002", "a", "mc=max(c) FILTER (b > 0); n=count(1); sb=sum(DISTINCT b)", "(sum(DISTINCT b) > 7)", "complete"), ("006", "", "latest=max(struct(b, c))", "", "complete"),
    ),
    "q_a4_arguments": rows_sql(
        "stmt VARCHAR, column VARCHAR, function VARCHAR, argument VARCHAR, is_distinct BOOLEAN, filter VARCHAR",
        ("002", "sb", "sum", "b", True, None), ("002", "n", "count", "1", False, None), ("002", "mc", "max", "c", False, "(b > 0)"), ("006", "latest", "max", "struct(b, c)", False, None),
    ),
    "q_a8_row_selection": rows_sql("stmt VARCHAR, source VARCHAR, source_column VARCHAR, transform VARCHAR, role VARCHAR", ("006", "s.t", "c", "AGGREGATE", "value"), ("006", "s.t", "b", "AGGREGATE", "order")),
    "q_w3_windows": rows_sql(
        "stmt VARCHAR, column VARCHAR, function VARCHAR, argument VARCHAR, partition_by VARCHAR, order_by VARCHAR, frame VARCHAR, status VARCHAR",
        ("003", "rn", "row_number", "", "a", "b DESC", "", "complete"), ("003", "run", "sum", "b", "a", "c ASC", "ROWS BETWEEN 1 PRECEDING AND CURRENT ROW", "complete"),
    ),
    "q_w5_window_filters": rows_sql("stmt VARCHAR, window_scope VARCHAR, window_column VARCHAR, filter_scope VARCHAR, expression VARCHAR", ("003", "subq:w", "rn", "ROOT", "(rn = 1)")),
    "q_u3_alignment": rows_sql(
        "stmt VARCHAR, ord INTEGER, column VARCHAR, branch INTEGER, branch_column VARCHAR, status VARCHAR",
        ("004", 0, "a", 0, "a", "aligned"), ("004", 1, "x", 0, "x", "aligned"), ("004", 0, "a", 1, "a", "aligned"), ("004", 1, "x", 1, "0", "aligned"), ("004", 0, "a", 2, "e", "aligned"), ("004", 1, "x", 2, None, "missing"),
    ),
    "q_u4_branch_sources": rows_sql(
        "stmt VARCHAR, column VARCHAR, branch INTEGER, source_kind VARCHAR, source VARCHAR, source_column VARCHAR",
        ("004", "a", 0, _P, "s.t", "a"), ("004", "x", 0, _P, "s.t", "b"), ("004", "a", 1, _P, "s.u", "a"), ("004", "x", 1, "generated", "CONSTANT", "0"), ("004", "a", 2, _P, "s.v", "e"),
    ),
    "q_p19_dependencies": rows_sql("stmt VARCHAR, kind VARCHAR, tables VARCHAR", ("005", "where", "s.v"), ("005", "where", "s.u")),
    "q_b11_aliases": rows_sql(
        "stmt VARCHAR, scope VARCHAR, alias VARCHAR, source_type VARCHAR, tables VARCHAR",
        ("001", "ROOT", "t", "table", "s.t"), ("001", "ROOT", "u", "table", "s.u"), ("002", "ROOT", "t", "table", "s.t"), ("002", "ROOT", "u", "table", "s.u"), ("003", "ROOT", "x", "table", "s.t"), ("003", "ROOT", "y", "table", "s.u"),
        ("004", "cte:p", "t", "table", "s.t"), ("004", "cte:q", "p", "scope", "s.t"), ("004", "ROOT", "q", "scope", "s.t"), ("004", "ROOT", "z", "scope", "s.u"), ("004", "subq:z", "u", "table", "s.u"),
        ("005", "ROOT", "t", "table", "s.t"), ("005", "ROOT", "u", "table", "s.u"),
    ),
    "q_b12_bindings": rows_sql(
        "stmt VARCHAR, scope VARCHAR, column VARCHAR, alias VARCHAR, field VARCHAR",
        ("001", "ROOT", "a", "t", "a"), ("001", "ROOT", "a", "u", "a"), ("001", "ROOT", "b", "t", "b"), ("001", "ROOT", "d", "u", "d"), ("002", "ROOT", "a", "t", "a"), ("002", "ROOT", "d", "u", "d"),
        ("003", "ROOT", "c", "x", "c"), ("003", "ROOT", "d", "y", "d"), ("004", "cte:p", "k", "t", "a"), ("004", "cte:p", "c", "t", "c"), ("004", "cte:q", "j", "p", "k"), ("004", "subq:z", "i", "u", "a"), ("004", "subq:z", "d", "u", "d"),
        ("004", "ROOT", "j", "q", "j"), ("004", "ROOT", "d", "z", "d"), ("005", "ROOT", "a", "u", "a"), ("005", "ROOT", "b", "t", "b"),
    ),
    "q_x9_physical_inputs": rows_sql(
        "stmt VARCHAR, scope VARCHAR, source VARCHAR", *[(f"00{n}", "ROOT", t) for n in (1, 2, 3, 4, 5) for t in ("s.t", "s.u")], ("004", "cte:p", "s.t"), ("004", "cte:q", "s.t"), ("004", "subq:z", "s.u"),
    ),
    "q_x15_outputs": rows_sql(
        "stmt VARCHAR, scope VARCHAR, column VARCHAR, downstream VARCHAR, targets VARCHAR",
        *[(f"00{n}", "ROOT", c, "", c) for n, cs in ((1, "abd"), (2, "ad"), (3, "cd"), (4, "jd"), (5, "ab")) for c in cs],
        ("004", "cte:p", "k", "cte:q", "j"), ("004", "cte:p", "c", "", ""), ("004", "cte:q", "j", "ROOT", "j"), ("004", "subq:z", "i", "", ""), ("004", "subq:z", "d", "ROOT", "d"),
    ),
    "q_x18_block_targets": rows_sql(
        "stmt VARCHAR, scope VARCHAR, type VARCHAR, expression VARCHAR, targets VARCHAR",
        ("001", "ROOT", "case_when", "CASE WHEN (b > 10) THEN 'high' WHEN (b > 5) THEN c ELSE 'low' END", "tier"), ("001", "ROOT", "case_when", "if((c = 'x'), 1, 0)", "flag"),
        ("002", "ROOT", "aggregate", "sum(DISTINCT b)", "sb"), ("002", "ROOT", "aggregate", "count(1)", "n"), ("002", "ROOT", "aggregate", "max(c)", "mc"), ("002", "ROOT", "group_by", "a", "a,mc,n,sb"), ("002", "ROOT", "having", "(sum(DISTINCT b) > 7)", "a,mc,n,sb"),
        # the windows' outputs reach no target as values; the filter on one of them decides both
        ("003", "ROOT", "filter", "(rn = 1)", "a,c"),
        ("005", "ROOT", "filter", "(b IN (...))", "a"), ("005", "ROOT", "filter", "EXISTS(...)", "a"),
        ("006", "ROOT", "aggregate", "max(struct(b, c)).c", "latest"),
    ),
    "q_t20_dropped_writes": rows_sql(
        "stmt VARCHAR, type VARCHAR, detail VARCHAR",
        *[(f"00{n}", "write_statement_dropped", d) for n, d in ((2, "INSERT m.w"), (3, "INSERT_OVERWRITE directory:/tmp/out"), (4, "CTAS m.p"), (5, "INSERT_OVERWRITE m.q"), (6, "INSERT m.w"))],
    ),
    "q_x16_chains": rows_sql(
        "stmt VARCHAR, chain VARCHAR, target VARCHAR, step_no INTEGER, scope VARCHAR, column VARCHAR",
        *[(f"00{n}", f"mc:00{k + 1}", c, 1, "ROOT", c) for n, cs in ((1, "abd"), (2, "ad"), (3, "cd"), (5, "ab")) for k, c in enumerate(cs)],
        ("004", "mc:001", "j", 1, "cte:p", "k"), ("004", "mc:001", "j", 2, "cte:q", "j"), ("004", "mc:001", "j", 3, "ROOT", "j"), ("004", "mc:002", "d", 1, "subq:z", "d"), ("004", "mc:002", "d", 2, "ROOT", "d"),
    ),
    "q_x27_gap_kinds": rows_sql(
        "stmt VARCHAR, type VARCHAR, sub_bucket VARCHAR, owner_hint VARCHAR, scope VARCHAR, column VARCHAR, root_impact BOOLEAN, recovered BOOLEAN",
        ("001", "expression_source_unresolved", "join_without_metadata", "metadata", "ROOT", "who", True, True), ("002", "alias_binding_missing", "name_not_found", "sql", "cte:p", "nowhere", False, False),
        ("003", "expression_source_unresolved", "join_without_metadata", "metadata", "ROOT", "who", True, False),
    ),
    "q_f8_features": rows_sql(
        "stmt VARCHAR, column VARCHAR, operators VARCHAR, has_case BOOLEAN, has_cast BOOLEAN, has_aggregate BOOLEAN, has_window BOOLEAN, has_literal BOOLEAN",
        ("001", "tier", ">", True, False, False, False, True), ("001", "flag", "=", True, False, False, False, True), ("002", "sb", "", False, False, True, False, False), ("002", "mc", ">", False, False, True, False, True),
        ("003", "rn", "", False, False, False, True, False), ("006", "text", "", False, True, False, False, False),
    ),
    "q_x14_clauses": rows_sql(
        "stmt VARCHAR, scope VARCHAR, kind VARCHAR, expression VARCHAR, expanded VARCHAR, status VARCHAR",
        ("003", "ROOT", "where", "(x.a = y.a)", "(s.t.a = s.u.a)", "resolved"), ("003", "ROOT", "where", "(y.d > 3)", "(s.u.d > 3)", "resolved"), ("004", "ROOT", "join", "(q.j = z.i)", "(s.t.a = s.u.a)", "resolved"),
    ),
    "q_x36_effects": rows_sql(
        "stmt VARCHAR, relation VARCHAR, effect VARCHAR",
        ("001", "m.w", "APPEND"), ("002", "m.w", "APPEND"), ("003", "directory:/tmp/out", "REPLACE"), ("004", "m.p", "REPLACE"), ("005", "m.q", "REPLACE_PARTITION"), ("006", "m.w", "APPEND"),
    ),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: (lambda spark, sf_dir, q=q: q(spark, _facts(spark))) for k, q in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)

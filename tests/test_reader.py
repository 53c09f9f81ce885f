"""What the reader makes of each SQL construct."""

import pytest

from loomtrace.operators import trace
from loomtrace.plans.catalyst import ScriptError, parse, split_script
from loomtrace.plans.facts import analyze, qualified_fields

SCHEMA = {"db.a": ["id", "x", "y", "s"], "db.b": ["id", "z"], "db.c": ["id", "x"]}


def root(spark, sql, schema=SCHEMA):
    """(facts, {output: {(source, column, transform, role)}}) of one statement."""
    f = analyze(spark, [("t", sql)], schema)
    out = {}
    for r in trace.sources(f).collect():
        out.setdefault(r.column, set()).add((r.source, r.source_column, r.transform, r.role))
    return f, out


def warned(f):
    return {(r.type, r.detail) for r in f.warnings.collect()}


@pytest.mark.parametrize(
    "text,kinds",
    [
        ("select 1; select 2", ["sql", "sql"]),
        ("select ';' as a; -- c;\n;", ["sql", "comment"]),
        ("select 1;;select `a;b`", ["sql", "empty", "sql"]),
        ("/* a; b */ select \"x;y\" ; /* end */", ["sql", "comment"]),
        ("", []),
        ("select 'it''s; fine', 1 - -1;", ["sql"]),
    ],
)
def test_split(text, kinds):
    got = split_script(text)
    assert [s.kind for s in got] == kinds and [s.index for s in got] == list(range(len(kinds)))


def test_parse_errors_and_isolation(spark):
    with pytest.raises(ScriptError):
        parse(spark, "SELEC 1")
    f = analyze(spark, [("t", "SELEC 1; INSERT INTO db.t SELECT id FROM db.a")], SCHEMA)
    assert [(r.parse_status, r.kind) for r in f.statements.orderBy("idx").collect()] == [("failed", "FAILED"), ("ok", "INSERT")]
    f = analyze(spark, [("t", "INSERT INTO db.t SELECT id FROM db.b WHERE WHERE id > 0")], SCHEMA)
    assert f.statements.first().syntax_status == "recovered" and ("syntax_recovered", "WHERE") in warned(f)


@pytest.mark.parametrize(
    "sql,kind,target,mode",
    [
        ("INSERT INTO db.t SELECT id FROM db.a", "INSERT", "db.t", "none"),
        ("INSERT OVERWRITE TABLE db.t PARTITION (dt='1') SELECT id FROM db.a", "INSERT_OVERWRITE", "db.t", "static"),
        ("INSERT OVERWRITE TABLE db.t PARTITION (dt='1', hh) SELECT id, x FROM db.a", "INSERT_OVERWRITE", "db.t", "mixed"),
        ("INSERT OVERWRITE TABLE db.t PARTITION (hh) SELECT id, x FROM db.a", "INSERT_OVERWRITE", "db.t", "dynamic"),
        ("INSERT OVERWRITE DIRECTORY '/tmp/x' USING parquet SELECT id FROM db.a", "INSERT_OVERWRITE", "directory:/tmp/x", "none"),
        ("CREATE TABLE db.t AS SELECT id FROM db.a", "CTAS", "db.t", "none"),
        ("CREATE TABLE db.t WITH q AS (SELECT id FROM db.a) SELECT * FROM q", "CTAS", "db.t", "none"),
        ("CREATE OR REPLACE VIEW db.v AS SELECT id FROM db.a", "CTAS", "db.v", "none"),
        ("CREATE GLOBAL TEMPORARY VIEW v AS SELECT id FROM db.a", "CTAS", "global_temp.v", "none"),
        ("CACHE LAZY TABLE v AS SELECT id FROM db.a", "CTAS", "v", "none"),
        ("DELETE FROM db.a WHERE id = 1", "DELETE", "db.a", "none"),
        ("UPDATE db.a SET x = 1", "UPDATE", "db.a", "none"),
        ("TRUNCATE TABLE db.a PARTITION (dt='1')", "TRUNCATE", "db.a", "static"),
        ("TRUNCATE TABLE db.a", "TRUNCATE", "db.a", "none"),
        ("MERGE INTO db.a t USING db.b s ON t.id = s.id WHEN MATCHED THEN UPDATE SET x = s.z", "MERGE", "db.a", "none"),
        ("SELECT 1", "SELECT", "", "none"),
        ("ALTER TABLE db.a ADD COLUMNS (q INT)", "OTHER", "", "none"),
    ],
)
def test_statement_kinds(spark, sql, kind, target, mode):
    r = analyze(spark, [("t", sql)], SCHEMA).statements.first()
    assert (r.kind, r.target, r.partition_mode) == (kind, target, mode)


def test_multi_insert(spark):
    f = analyze(spark, [("t", "FROM db.a INSERT INTO db.t SELECT id INSERT INTO db.u SELECT x")], SCHEMA)
    assert [(r.stmt, r.target) for r in f.statements.orderBy("stmt").collect()] == [("stmt:001", "db.t"), ("stmt:001.2", "db.u")]
    got = {(r.stmt, r.column, r.source, r.source_column) for r in trace.sources(f).collect()}
    assert got == {("stmt:001", "id", "db.a", "id"), ("stmt:001.2", "x", "db.a", "x")}


def test_values(spark):
    f, out = root(spark, "INSERT INTO db.t (p, q) VALUES (1, 'a'), (2, 'b')")
    assert set(out) == {"p", "q"}
    f, out = root(spark, "INSERT INTO db.b VALUES (1, 2)")
    assert set(out) == {"id", "z"}
    f, out = root(spark, "INSERT INTO db.other VALUES (1, 2)")
    assert set(out) == {"value_1", "value_2"}


@pytest.mark.parametrize(
    "expression,transform,name",
    [
        ("x", "DIRECT", "x"),
        ("x + 1 AS w", "EXPRESSION", "w"),
        ("sum(x) AS w", "AGGREGATE", "w"),
        ("sum(x) / count(y) AS w", "EXPRESSION", "w"),
        ("row_number() OVER (ORDER BY x) AS w", "WINDOW", "w"),
        ("CASE WHEN x > 1 THEN y END AS w", "CONDITIONAL", "w"),
        ("if(x > 1, y, 0) AS w", "CONDITIONAL", "w"),
        ("7 AS w", "CONSTANT", "w"),
        ("cast(x AS string) AS w", "EXPRESSION", "w"),
        ("s.field", "DIRECT", "field"),
        ("upper(x)", "EXPRESSION", "_col_1"),
    ],
)
def test_transform_classes(spark, expression, transform, name):
    f = analyze(spark, [("t", f"INSERT INTO db.t SELECT {expression} FROM db.a")], SCHEMA)
    r = f.columns.filter("scope = 'ROOT'").first()
    assert (r.transform, r.column) == (transform, name)
    assert r.name_generated == name.startswith("_col_")


def test_constants_system_and_rowsets(spark):
    _, out = root(spark, "INSERT INTO db.t SELECT 1 AS one, current_date() AS day, count(*) AS n, row_number() OVER (PARTITION BY x ORDER BY y) AS rn FROM db.a")
    assert {x[0] for x in out["one"]} == {"CONSTANT"} and {x[0] for x in out["day"]} == {"SYSTEM"}
    assert out["n"] == {("db.a", "*", "AGGREGATE", "value")}
    assert out["rn"] == {("db.a", "*", "WINDOW", "value"), ("db.a", "x", "WINDOW", "partition"), ("db.a", "y", "WINDOW", "order")}


def test_ambiguous_names_are_not_guessed(spark):
    f, out = root(spark, "INSERT INTO db.t SELECT x FROM db.a a JOIN db.c c ON a.id = c.id")
    assert {(x[0], x[3]) for x in out["x"]} == {("ambiguous_unqualified", "value"), ("db.a", "candidate"), ("db.c", "candidate")}
    assert ("ambiguous_unqualified", "x") in warned(f)
    _, out = root(spark, "INSERT INTO db.t SELECT z, x FROM db.a a JOIN db.b b ON a.id = b.id")  # metadata decides
    assert out == {"z": {("db.b", "z", "DIRECT", "value")}, "x": {("db.a", "x", "DIRECT", "value")}}
    _, out = root(spark, "INSERT INTO db.t SELECT m FROM db.a JOIN db.dark ON true")  # only the unknown table can have it
    assert out["m"] == {("db.dark", "m", "DIRECT", "value")}


def test_unknown_names(spark):
    f, out = root(spark, "INSERT INTO db.t SELECT nope.x AS p, q FROM db.a, db.b")
    assert {x[0] for x in out["p"]} == {x[0] for x in out["q"]} == {"unknown_source"}
    assert {t for t, _ in warned(f)} >= {"unresolved_alias", "column_not_found"}
    f, out = root(spark, "INSERT INTO db.t SELECT a.missing FROM db.a a")
    assert ("column_not_in_table_schema", "a.missing") in warned(f) and out["missing"] == {("db.a", "missing", "DIRECT", "value")}
    f, out = root(spark, "INSERT INTO db.t SELECT q.gone FROM (SELECT id FROM db.a) q")
    assert ("dangling_column_ref_dropped", "q.gone") in warned(f)


def test_stars(spark):
    _, out = root(spark, "INSERT INTO db.t SELECT * FROM db.b")
    assert set(out) == {"id", "z"}
    _, out = root(spark, "INSERT INTO db.t SELECT b.*, a.x FROM db.a a JOIN db.b b ON a.id = b.id")
    assert set(out) == {"id", "z", "x"}
    f, out = root(spark, "INSERT INTO db.t SELECT * EXCEPT (y, s, none) FROM db.a")
    assert set(out) == {"id", "x"} and ("star_except_column_not_found", "none") in warned(f)
    f, out = root(spark, "INSERT INTO db.t SELECT * FROM db.dark")
    assert out == {"*": {("star_not_expanded", "db.dark", "EXPAND_ALL", "value")}} and ("star_not_expanded", "db.dark") in warned(f)
    _, out = root(spark, "INSERT INTO db.t SELECT q.m + 1 AS w FROM (SELECT * FROM db.dark) q")  # a reference proves the column
    assert out["w"] == {("db.dark", "m", "EXPRESSION", "value")}
    _, out = root(spark, "INSERT INTO db.t SELECT * FROM db.a JOIN db.b USING (id)")
    assert sorted(out) == ["id", "s", "x", "y", "z"]


def test_regex_columns_follow_the_setting(spark):
    f = analyze(spark, [("t", "INSERT INTO db.t SELECT `(x|y)` FROM db.a")], SCHEMA)
    assert "regex" not in {t for t, _ in warned(f)}
    on = "SET spark.sql.parser.quotedRegexColumnNames=true; INSERT INTO db.t SELECT * FROM db.a"
    assert analyze(spark, [("t", on)], SCHEMA).columns.count() == 4


def test_union_and_set_operations(spark):
    f, out = root(spark, "INSERT INTO db.t SELECT id AS k FROM db.a UNION ALL SELECT z FROM db.b UNION ALL SELECT x FROM db.c")
    assert {(x[0], x[1]) for x in out["k"]} == {("db.a", "id"), ("db.b", "z"), ("db.c", "x")} and {x[2] for x in out["k"]} == {"UNION"}
    assert {r.scope for r in f.scopes.collect()} == {"ROOT", "union:main", "union:main:b00", "union:main:b01", "union:main:b02"}
    for op, label in (("UNION", "UNION"), ("UNION ALL", "UNION_ALL"), ("INTERSECT", "INTERSECT"), ("EXCEPT", "EXCEPT")):
        f = analyze(spark, [("t", f"INSERT INTO db.t SELECT id FROM db.a {op} SELECT id FROM db.b")], SCHEMA)
        assert f.scopes.filter("scope = 'union:main'").first().set_op == label
    f, _ = root(spark, "INSERT INTO db.t SELECT id, x FROM db.a UNION ALL SELECT id FROM db.a")
    assert warned(f) >= {("union_branch_arity_mismatch", "2,1"), ("duplicate_table_in_union", "db.a")}


def test_subqueries(spark):
    f, out = root(spark, "INSERT INTO db.t SELECT a.id, (SELECT max(b.z) FROM db.b b WHERE b.id = a.id) AS best FROM db.a a WHERE EXISTS (SELECT 1 FROM db.c c WHERE c.id = a.id) AND a.x IN (SELECT z FROM db.b)")
    assert out["best"] == {("db.b", "z", "AGGREGATE", "value")} and out["id"] == {("db.a", "id", "DIRECT", "value")}
    assert f.scopes.filter("kind = 'subquery'").count() == 3
    fields = {(r.src_scope, r.src_column) for r in f.predicate_fields.collect()}
    assert fields >= {("db.b", "id"), ("db.a", "id"), ("db.c", "id"), ("db.a", "x")}


def test_ctes_shadow_tables_and_chain(spark):
    _, out = root(spark, "INSERT INTO db.t WITH a AS (SELECT id AS k FROM db.a), b AS (SELECT k + 1 AS k FROM a) SELECT sum(k) AS total FROM b")
    assert out["total"] == {("db.a", "id", "AGGREGATE", "value")}
    _, out = root(spark, "WITH q (p) AS (SELECT id FROM db.a) INSERT INTO db.t SELECT p FROM q")
    assert out["p"] == {("db.a", "id", "DIRECT", "value")}


def test_lateral_views_and_lambdas(spark):
    _, out = root(spark, "INSERT INTO db.t SELECT e.v, e.p, transform(a.x, q -> q + 1) AS m FROM db.a a LATERAL VIEW posexplode(a.y) e AS p, v")
    assert out["v"] == out["p"] == {("db.a", "y", "EXPRESSION", "value")} and {x[1] for x in out["m"]} == {"x"}
    f, _ = root(spark, "INSERT INTO db.t SELECT e.v FROM db.a LATERAL VIEW OUTER explode(y) e AS v")
    assert {(r.alias, r.position) for r in f.inputs.filter("scope = 'ROOT'").collect()} == {("a", "from"), ("e", "lateral_view")}


def test_pivot(spark):
    _, out = root(spark, "INSERT INTO db.t SELECT * FROM (SELECT id, x, y FROM db.a) PIVOT (sum(y) FOR x IN ('p', 'q' AS other))")
    assert set(out) == {"id", "p", "other"} and {(x[1], x[3]) for x in out["p"]} == {("y", "value"), ("x", "filter")}


@pytest.mark.parametrize(
    "join,label", [("JOIN", "INNER"), ("LEFT JOIN", "LEFT_OUTER"), ("RIGHT JOIN", "RIGHT_OUTER"), ("FULL JOIN", "FULL_OUTER"), ("LEFT SEMI JOIN", "LEFT_SEMI"), ("LEFT ANTI JOIN", "LEFT_ANTI")]
)
def test_join_types_and_keys(spark, join, label):
    f = analyze(spark, [("t", f"INSERT INTO db.t SELECT a.x FROM db.a a {join} db.b b ON b.id = a.id AND b.z > 3")], SCHEMA)
    j, k = f.joins.first(), f.join_keys.first()
    assert (j.join_type, j.status, j.n_filters) == (label, "complete", 1)
    assert (k.left_alias, k.left_column, k.right_alias, k.right_column) == ("a", "id", "b", "id")
    assert "filter_in_join_on_clause" in {t for t, _ in warned(f)}


def test_cross_self_and_theta_joins(spark):
    assert analyze(spark, [("t", "INSERT INTO db.t SELECT a.x FROM db.a a CROSS JOIN db.b b")], SCHEMA).joins.first().join_type == "CROSS"
    f = analyze(spark, [("t", "INSERT INTO db.t SELECT p.x FROM db.a p JOIN db.a q ON p.id = q.y AND p.x < q.x")], SCHEMA)
    assert f.join_keys.first()[4:] == ("p", "id", "q", "y", "on") and f.joins.first().n_filters == 1
    assert analyze(spark, [("t", "INSERT INTO db.t SELECT p.x FROM db.a p JOIN db.b q ON p.id < q.id")], SCHEMA).joins.first().status == "partial"


def test_merge_branches_see_what_they_may(spark):
    f, out = root(spark, "MERGE INTO db.a t USING db.b s ON t.id = s.id WHEN MATCHED THEN UPDATE SET x = t.x + s.z WHEN NOT MATCHED THEN INSERT (id, y) VALUES (s.id, s.z) WHEN NOT MATCHED BY SOURCE THEN UPDATE SET s = t.y")
    assert {(x[0], x[1]) for x in out["x"]} == {("db.a", "x"), ("db.b", "z")} and {(x[0], x[1]) for x in out["s"]} == {("db.a", "y")}
    assert {r.merge_branch for r in f.columns.collect()} == {"matched:0", "not_matched:0", "not_matched_by_source:0"}
    f, out = root(spark, "MERGE INTO db.c t USING db.a s ON t.id = s.id WHEN MATCHED THEN UPDATE SET * WHEN NOT MATCHED THEN INSERT *")
    assert {(x[0], x[1]) for x in out["x"]} == {("db.a", "x")}
    f, _ = root(spark, "MERGE INTO db.c t USING db.b s ON t.id = s.id WHEN MATCHED THEN UPDATE SET *")
    assert ("merge_star_target_column_missing_in_source", "x") in warned(f)


def test_grouping_having_order_distinct(spark):
    f = analyze(spark, [("t", "INSERT INTO db.t SELECT x, count(DISTINCT y) AS n FROM db.a GROUP BY 1 HAVING count(*) > 1 ORDER BY n DESC, x")], SCHEMA)
    assert [(r.expression, r.src_column) for r in f.groupings.collect()] == [("x", "x")]
    assert f.predicates.first().kind == "having" and [r.direction for r in f.orders.orderBy("ord").collect()] == ["DESC", "ASC"]
    c = f.columns.filter("column = 'n'").first()
    assert (c.aggregate, c.is_distinct) == ("count", True)
    assert analyze(spark, [("t", "INSERT INTO db.t SELECT DISTINCT x FROM db.a")], SCHEMA).scopes.first().is_distinct


def test_filters(spark):
    f = analyze(spark, [("t", "INSERT INTO db.t SELECT x FROM db.dark WHERE dt = '1' AND is_deleted = 0 AND name <> 'test' AND (a > 1 OR b > 2)")])
    got = [(r.subtype, r.partition_filter) for r in f.predicates.orderBy("ord").collect()]
    assert got == [(None, True), ("delete_filter", False), ("test_data_filter", False), (None, False)]


def test_script_local_columns(spark):
    f = analyze(spark, [("t", "CREATE TABLE db.n AS SELECT id AS k, x FROM db.a; INSERT INTO db.t SELECT * FROM db.n")], SCHEMA)
    assert {r.column for r in f.columns.filter("stmt = 'stmt:002'").collect()} == {"k", "x"}


def test_qualified_fields(spark):
    assert qualified_fields(spark, "a.x + upper(b.y) + 'c.z' + transform(d.w, e -> e + f.g)") == ["a.x", "b.y", "d.w", "f.g"]


def test_keywords_as_columns(spark):
    _, out = root(spark, "INSERT INTO db.t SELECT k.not, k.like FROM db.k k", {"db.k": ["not", "like"]})
    assert set(out) == {"not", "like"}

"""Expanded expressions, their budget, and the command line."""

import json

import pytest

from loomtrace.__main__ import main
from loomtrace.operators import trace
from loomtrace.plans import expand
from loomtrace.plans.catalyst import parse
from loomtrace.plans.facts import Facts, analyze
from loomtrace.plans.reader import Reader

SCHEMA = {"db.a": ["id", "x", "y"], "db.b": ["id", "z"]}


def expanded(spark, sql):
    return {r.column: (r.expanded, r.status) for r in analyze(spark, [("t", sql)], SCHEMA).expansions.filter("scope = 'ROOT'").collect()}


@pytest.mark.parametrize(
    "sql,column,text",
    [
        ("INSERT INTO t SELECT x + 1 AS w FROM db.a", "w", "(db.a.x + 1)"),
        ("INSERT INTO t SELECT q.w * 2 AS v FROM (SELECT x + y AS w FROM db.a) q", "v", "((db.a.x + db.a.y) * 2)"),
        ("INSERT INTO t WITH q AS (SELECT upper(x) AS w FROM db.a) SELECT w FROM q", "w", "upper(db.a.x)"),
        ("INSERT INTO t SELECT coalesce(q.w, b.z) AS v FROM (SELECT CASE WHEN x > 1 THEN y END AS w, id FROM db.a) q JOIN db.b b ON q.id = b.id", "v", "coalesce((CASE WHEN (db.a.x > 1) THEN db.a.y END), db.b.z)"),
        ("INSERT INTO t SELECT * FROM (SELECT sum(x) AS total FROM db.a) q", "total", "sum(db.a.x)"),
        ("INSERT INTO t SELECT id AS k FROM db.a UNION ALL SELECT z + 1 FROM db.b", "k", "UNION(db.a.id, (db.b.z + 1))"),
        ("INSERT INTO t SELECT transform(x, e -> e + y) AS m FROM db.a", "m", "transform(db.a.x, (e) -> (e + db.a.y))"),
    ],
)
def test_expansion(spark, sql, column, text):
    got = expanded(spark, sql)[column]
    assert got[1] == "resolved" and got[0].strip("()") == text.strip("()")


def test_unresolved_parts_are_told(spark):
    f = analyze(spark, [("t", "INSERT INTO t SELECT q.w + 1 AS v FROM (SELECT nope.x AS w FROM db.a) q")], SCHEMA)
    r = f.expansions.filter("scope = 'ROOT'").first()
    assert r.status == "partially_resolved" and set(r.reasons) == {"alias_not_bound_to_input_source", "upstream_output_unresolved"}


def test_budget_bounds_text_and_not_facts(spark):
    sql = "SELECT x AS x FROM db.a"
    for i in range(30):
        sql = f"SELECT q{i}.x + q{i}.x AS x FROM ({sql}) q{i}"
    f = analyze(spark, [("t", f"INSERT INTO t {sql}")], SCHEMA)
    rows = f.expansions.collect()
    assert max(len(r.expanded) for r in rows) < 2 * expand.MOST_CHARACTERS + 1000 and max(r.substitutions for r in rows) <= expand.MOST_SUBSTITUTIONS
    assert any("expansion_budget_exceeded" in r.reasons for r in rows)
    assert [(r.source, r.source_column) for r in trace.sources(f).collect()] == [("db.a", "x")]
    reader = Reader(SCHEMA)
    reader.read(parse(spark, "INSERT INTO t SELECT q.w + q.w AS v FROM (SELECT x + y AS w FROM db.a) q"))
    small = expand.Expander(reader, substitutions=1).column("ROOT", "v")
    assert small.substitutions == 1 and small.text == "((db.a.x + db.a.y) + subq:q.w)" and small.reasons == {"expansion_budget_exceeded"}


def test_command_line(spark, tmp_path, capsys):
    tasks = tmp_path / "tasks"
    tasks.mkdir()
    put = lambda where, **content: where.write_text(json.dumps(content))
    put(tasks / "one.json", meta=dict(task_name="one", sql="INSERT INTO m.t SELECT x FROM db.a; DROP TABLE z"))
    put(tasks / "two.json", task_name="two", sql="INSERT INTO m.u SELECT * FROM db.dark")
    schema = tmp_path / "schema.json"
    schema.write_text(json.dumps(SCHEMA))
    out = str(tmp_path / "out")
    run = lambda *more: main(["parse", "--input-dir", str(tasks), "--schema", str(schema), "--out", out, *more])
    assert run() == 0 and run("--quality", "balanced") == 1 and run("--fail-on-unsupported") == 1 and run("--fail-on-gaps") == 1 and run("--fail-on-recovered") == 0
    f = Facts.read(spark, out)
    assert {r.task for r in f.statements.collect()} == {"one", "two"}
    assert main(["render", "--facts", out, "--out", str(tmp_path / "docs")]) == 0
    assert "m.t" in spark.read.parquet(str(tmp_path / "docs" / "mapping")).filter("task = 'one'").first().markdown
    put(tasks / "three.json", task_name="two", sql="SELECT 1")
    assert run() == 2 and "several files" in capsys.readouterr().err
    empty = tmp_path / "empty"
    empty.mkdir()
    (empty / "x.json").write_text("{}")
    assert main(["parse", "--task-file", str(empty), "--out", out]) == 2
    script = tmp_path / "job.sql"
    script.write_text("INSERT INTO m.t SELECT id FROM db.b;")
    assert main(["parse", "--sql-file", str(script), "--out", out, "--markdown", "--quality", "strict"]) == 0
    assert Facts.read(spark, out).statements.first().task == "job"


def test_public_names_resolve_and_load_nothing_early():
    import subprocess
    import sys

    import loomtrace

    assert all(callable(getattr(loomtrace, n)) for n in loomtrace.__all__)
    code = "import sys, loomtrace; print([m for m in sys.modules if m.startswith(('pyspark', 'pandas', 'loomtrace.'))])"
    assert subprocess.run([sys.executable, "-c", code], capture_output=True, text=True).stdout.strip() == "[]"


def test_display_struct_paths_and_schema_fields(spark):
    f = analyze(spark, [("t", "INSERT INTO t SELECT p.x + q.z AS v, p.y.f.g AS w FROM db.a p JOIN db.b q ON p.id = q.id")], SCHEMA)
    assert {r.column: r.display for r in f.expansions.collect()} == {"v": "(db.a.x + db.b.z)", "w": "db.a.y.f.g"}
    assert {(r.column, r.src_column, r.src_path) for r in f.column_sources.collect()} == {("v", "x", ""), ("v", "z", ""), ("w", "y", "f.g")}
    f = analyze(spark, [("t", "INSERT INTO t SELECT upper(k.x) AS v, y.f FROM db.a k")], SCHEMA)
    assert {r.column: r.display for r in f.expansions.collect()} == {"v": "upper(x)", "f": "y.f"}
    f = analyze(spark, [("t", "INSERT INTO t SELECT e.one, two FROM db.a LATERAL VIEW inline(from_json(x, 'array<struct<one:int,two:string>>')) e")], SCHEMA)
    assert {(r.column, r.source_column) for r in trace.sources(f).collect()} == {("one", "x"), ("two", "x")}
    text = {r.target: r.chain for r in trace.chain_text(analyze(spark, [("t", "INSERT INTO t SELECT q.w + 1 AS v FROM (SELECT x AS w FROM db.a) q")], SCHEMA)).collect()}
    assert text == {"v": "subq:q.w: x -> ROOT.v: (q.w + 1)"}

"""Metadata lookup and intake, documents, and the reader's rules on missing metadata."""

import json

import pytest

from loomtrace.__main__ import main
from loomtrace.operators import links, publish, states, trace
from loomtrace.plans.catalyst import ScriptError
from loomtrace.plans.facts import analyze
from loomtrace.plans.reader import Reader, Tables
from loomtrace.sources import metadata, scripts


def test_lookup_is_exact_before_it_is_by_key():
    t = Tables({"cat1.db.t": ["a"], "cat2.db.t": ["b"], "db.u": ["c"], "Cat3.DB.`v`": ["d"]})
    assert t.get("cat1.db.t") == ["a"] and t.get("`cat2`.db.T") == ["b"] and t.get("db.t") is None  # which one is not known
    assert t.get("other.db.u") == ["c"] and t.get("db.v") == ["d"]
    under = t.under({"db.t": ["x"], "db.u": ["y"]})
    assert under.get("db.t") == ["x"] and under.get("db.u") == ["c"]


def test_any_failure_of_one_statement_leaves_the_others(spark, monkeypatch):
    real = Reader.read

    def read(self, parsed):
        if "boom" in str(parsed.tree.walk().__next__().fields) or any("boom" in str(n.fields.get("multipartIdentifier")) for n in parsed.tree.walk()):
            return read(self, parsed)  # never ends: a RecursionError
        return real(self, parsed)

    monkeypatch.setattr(Reader, "read", read)
    f = analyze(spark, [("t", "INSERT INTO a SELECT x FROM one; INSERT INTO b SELECT x FROM boom; INSERT INTO c SELECT x FROM two"), ("u", "INSERT INTO d SELECT x FROM three")])
    got = {(r.task, r.stmt[-1]): (r.kind, r.parse_status) for r in f.statements.collect()}
    assert got == {("t", "1"): ("INSERT", "ok"), ("t", "2"): ("FAILED", "failed"), ("t", "3"): ("INSERT", "ok"), ("u", "1"): ("INSERT", "ok")}
    assert {r.source for r in trace.sources(f).collect()} == {"one", "two", "three"}


def test_relations_that_are_not_modelled_fail_alone(spark):
    from loomtrace.plans.catalyst import Node

    reader = Reader()
    with pytest.raises(ScriptError, match="not modelled: Strange"):
        reader._from(reader._new("ROOT", "root", None), Node("Strange", {}), "from", {})


def test_columns_that_only_conditions_prove(spark):
    f = analyze(spark, [("t", "INSERT INTO m.o SELECT * FROM db.a WHERE db.a.late = 1")], {"db.a": ["id", "x"]})
    assert [r.column for r in f.columns.orderBy("ord").collect()] == ["id", "x", "late"]
    assert ("schema_missing_column_kept", "db.a.late") in {(r.type, r.detail) for r in f.warnings.collect()}


def test_union_names_from_another_branch(spark):
    f = analyze(spark, [("t", "INSERT INTO m.o SELECT id, id FROM db.a UNION ALL SELECT x, y FROM db.b")])
    assert [r.column for r in f.columns.filter("scope = 'union:main'").orderBy("ord").collect()] == ["id", "y"]


def test_target_exports(spark, tmp_path):
    def export(name, **fields):
        (tmp_path / name).write_text(json.dumps(fields))

    column = lambda n, i: {"columnName": n, "columnType": "string", "columnIndex": i}
    export("old.json", table_name="db.t", query_time="2024-01-01 00:00:00", schema=[column("gone", 0)])
    export("new.json", table_name="db.t", query_time="2024-02-01 00:00:00", ddl="CREATE TABLE db.t (id BIGINT COMMENT 'key', not STRING, dt STRING) PARTITIONED BY (dt)", schema=[column("id", 0), column("dt", 1)])
    export("list.json", full_table_name="Cat.DB.U", table_name="u", schema=[column("B", 1), column("A", 0)])
    (tmp_path / "broken.json").write_text("{ no json")
    columns, problems = metadata.read_targets(spark, str(tmp_path))
    got = [(r.relation, r.column, r.is_partition) for r in columns.orderBy("relation", "ordinal").collect()]
    assert got == [("cat.db.u", "a", False), ("cat.db.u", "b", False), ("db.t", "id", False), ("db.t", "not", False), ("db.t", "dt", True)]
    assert sorted(r.problem for r in problems.collect()) == ["columns_differ_from_ddl", "invalid_json"]
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "x.json").write_text("[")
    with pytest.raises(metadata.MetadataFileError):
        metadata.read_targets(spark, str(tmp_path / "none"))


def test_merge_fills_what_the_first_source_lacks(spark):
    shape = lambda rows, o: spark.createDataFrame([(*r, o) for r in rows], metadata.SHAPE)
    one = shape([("db.t", 0, "a", None, "first"), ("db.t", 1, "b", "int", None)], "one")
    two = shape([("db.t", 0, "a", "string", "second"), ("db.t", 1, "b", "bigint", "told"), ("db.u", 0, "x", "int", None)], "two")
    chosen, conflicts = metadata.merge([one, two])
    assert sorted((r.relation, r.column, r.type, r.comment) for r in chosen.collect()) == [("db.t", "a", "string", "first"), ("db.t", "b", "int", "told"), ("db.u", "x", "int", None)]
    assert conflicts.isEmpty()


def test_problems_of_metadata_files(spark, tmp_path):
    (tmp_path / "good.json").write_text('{"db.t": ["a"]}')
    (tmp_path / "bad.json").write_text("{ no")
    (tmp_path / "odd.json").write_text("3")
    (tmp_path / "n.csv").write_text("table,column\ndb.t,a\x00\x00b\n")
    got = {(r.file.rsplit("/", 1)[-1], r.problem, r.n) for r in metadata.problems(spark, [str(tmp_path)]).collect()}
    assert got == {("bad.json", "invalid_json", 1), ("odd.json", "no_columns", 1), ("n.csv", "nul_bytes", 2)}
    with pytest.raises(metadata.MetadataFileError, match="more than 10"):
        metadata.read_csv(spark, str(tmp_path / "n.csv"), "remove", 10)


def test_documents(spark):
    f = analyze(spark, [("t", "INSERT INTO m.o SELECT id AS k, who FROM db.a JOIN dark ON db.a.id = dark.id; SELEC 1")], {"db.a": ["id", "x"]})
    columns = spark.createDataFrame([("db.a", 0, "id", "int", "the key", "x")], metadata.SHAPE)
    tight, loose = (publish.statement_documents(f, columns, compact).first().document for compact in (True, False))
    assert json.loads(tight) == json.loads(loose) and "\n" in loose and "\n" not in tight
    assert {"relation": "db.a", "column": "id", "type": "int", "comment": "the key"} in json.loads(tight)["column_details"]
    task = json.loads(publish.task_documents(f, columns).first().document)
    assert task["statements"][0]["document"] == json.loads(tight) and "document" not in task["statements"][1]
    told = json.loads(publish.diagnostics_documents(f).first().document)
    assert {w["type"] for w in told["warnings"]} >= {"LINEAGE_ERROR"} and told["statistics"][0]["n_joins"] == 1
    bad = f.tables | {"joins": f.joins.withColumn("status", __import__("pyspark").sql.functions.lit("odd"))}
    assert "unknown_joins_status" in {r.problem for r in publish.violations(type(f)(bad)).collect()}


def test_blocking_reasons(spark):
    f = analyze(spark, [("t", "INSERT INTO m.o SELECT id FROM db.a; INSERT INTO m.p SELECT who FROM dark1 JOIN dark2 ON dark1.i = dark2.i")], {"db.a": ["id"], "m.o": ["id"]})
    columns = spark.createDataFrame([("db.a", 0, "id", None, None, "x"), ("m.o", 0, "id", None, None, "x")], metadata.SHAPE)
    conflicts = spark.createDataFrame([("db.far",)], "relation string")
    got = sorted(tuple(r) for r in states.blocking_reasons(f, columns, conflicts).collect())
    assert got == [("*", 1, "metadata_conflict", "db.far"), ("t", 2, "metadata_missing", "dark1"), ("t", 2, "metadata_missing", "dark2"), ("t", 2, "metadata_missing", "m.p"), ("t", 3, "root_gap", "m.p.who")]


def test_facts_that_do_not_fit_the_driver(spark):
    scripts_ = [(f"t{i}", f"INSERT INTO m.o{i} SELECT id + {i} AS x FROM db.a WHERE id > {i}") for i in range(6)]
    whole, parts = (analyze(spark, scripts_, {"db.a": ["id"]}, held) for held in (10**6, 20))
    for name in whole.tables:
        assert sorted(map(str, whole.tables[name].collect())) == sorted(map(str, parts.tables[name].collect())), name


def test_first_writes(spark):
    f = analyze(spark, [("t", "SET a=b; INSERT INTO m.o SELECT 1 AS x; INSERT INTO m.p SELECT 2 AS y")])
    kept, dropped = links.first_writes(f)
    assert {r.target for r in kept.collect()} == {"", "m.o"} and [(r.type, r.detail) for r in dropped.collect()] == [("write_statement_dropped", "INSERT m.p")]


def test_command_line_with_folders_targets_and_conflicts(spark, tmp_path):
    for folder in ("one", "two"):
        (tmp_path / "tasks" / folder).mkdir(parents=True)
        (tmp_path / "tasks" / folder / "same.json").write_text(json.dumps({"meta": {"sql": f"INSERT INTO m.{folder} SELECT id FROM db.a", "upstream_tasks": [{"task_name": "before", "task_id": "1"}]}}))
    (tmp_path / "a.json").write_text('{"db.a": ["id"]}')
    (tmp_path / "b.json").write_text('{"db.a": ["id", "more"]}')
    (tmp_path / "targets").mkdir()
    (tmp_path / "targets" / "t.json").write_text(json.dumps({"table_name": "m.one", "ddl": "CREATE TABLE m.one (id INT)"}))
    out = str(tmp_path / "out")
    args = ["parse", "--input-dir", str(tmp_path / "tasks"), "--schema", str(tmp_path / "a.json"), "--schema", str(tmp_path / "b.json"), "--target-metadata", str(tmp_path / "targets"), "--out", out, "--pretty", "--first-write-only"]
    assert main(args) == 0
    assert {r.task for r in spark.read.parquet(f"{out}/facts/statements").collect()} == {"one/same", "two/same"}
    assert {r.task for r in spark.read.parquet(f"{out}/task_dependencies").collect()} == {"one/same", "two/same"}
    assert [r.relation for r in spark.read.json(f"{out}/metadata_conflicts").collect()] == ["db.a"]
    assert scripts.mirrored(scripts.tasks(spark, str(tmp_path / "tasks")), str(tmp_path / "tasks")).count() == 2

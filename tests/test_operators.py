"""Fact operators, metadata, readers, documents and streaming."""

import json
import os

import pytest

from loomtrace.functions import expressions as E
from loomtrace.operators import audit, publish, states, trace
from loomtrace.plans import corpus, query_pack
from loomtrace.plans.facts import analyze
from loomtrace.session import views
from loomtrace.sources import metadata, scripts
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


# -- closure and trace


def test_closure_with_cycles(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "x"), ("y", "z")]
    got = {(r.upstream, r.downstream): r.distance for r in trace.closure(spark.createDataFrame(pairs, "upstream string, downstream string")).collect()}
    want = {}
    for s in "abcdxyz":
        seen, now, n = {s}, [s], 0
        while now:
            n += 1
            now = [d for u, d in pairs if u in now and d not in seen]
            for d in now:
                seen.add(d)
                want.setdefault((s, d), n)
    assert got == want
    assert {r.downstream for r in audit.impact_of(trace.closure(spark.createDataFrame(pairs, "upstream string, downstream string")), "a").collect()} == {"b", "c", "d"}


def test_long_chain_takes_few_rounds(spark):
    chain = spark.range(100).selectExpr("cast(id as string) upstream", "cast(id + 1 as string) downstream")
    assert trace.closure(chain, max_rounds=9).count() == 101 * 100 // 2


def test_deep_and_wide_statements_trace_in_time(spark):
    deep = "SELECT a0.x AS x FROM db.t a0"
    for i in range(1, 25):
        deep = f"SELECT a{i}.x + a{i}.x AS x FROM ({deep}) a{i}"
    got = trace.sources(analyze(spark, [("t", f"INSERT INTO db.u {deep}")])).collect()
    assert [(r.source, r.source_column, r.hops) for r in got] == [("db.t", "x", 24)]


@pytest.mark.parametrize("name", ["q_revenue_by_segment", "q_j2_left_outer", "q_u2_three_branches", "q_p5_case_if", "q_b10_correlated_value", "q_w2_lag_lead", "q_f2_cleaning", "q_f14_pivot"])
def test_only_traced_columns_matter(spark, name):
    """Changing a column that no output or row condition of a query uses leaves its rows alone, and outputs that
    don't come from a changed column keep their values."""
    tables, sql, _ = query_pack.PACK[name]
    schema = {t: spark.read.parquet(f"{SF}/{t}.parquet").columns for t in tables.split()}
    f = analyze(spark, [("t", sql)], schema)
    used = {(r.source, r.field) for r in audit.field_usage(f).collect()}
    views(spark, SF, tables.split())
    before = rows(spark.sql(sql))
    for t in tables.split():
        df = spark.read.parquet(f"{SF}/{t}.parquet")
        unused = [c for c in df.columns if (t, c) not in used]
        df.select([F.lit(None).cast(dict(df.dtypes)[c]).alias(c) if c in unused else F.col(c) for c in df.columns]).createOrReplaceTempView(t)
    assert rows(spark.sql(sql)) == before
    views(spark, SF, tables.split())
    if "PIVOT" in sql:  # a pivot's counts depend on all its implicit groups
        assert {r.src_column for r in f.groupings.collect()} == {"o_orderpriority"}
        return
    touched = {}
    for r in trace.sources(f).filter("source_kind = 'physical'").collect():
        touched.setdefault((r.source, r.source_column), set()).add(r.column)
    conditions = {(r.src_scope, r.src_column) for r in f.predicate_fields.collect()} | {(r.src_scope, r.src_column) for r in f.groupings.collect()}
    keys = {(r.source, r.field) for r in audit.field_usage(f).filter("used_by like '%join%' or used_by like '%window%'").collect()}
    for (t, c), outputs in touched.items():
        if (t, c) in conditions | keys or t not in tables.split():
            continue
        df = spark.read.parquet(f"{SF}/{t}.parquet")
        df.withColumn(c, F.lit(None).cast(dict(df.dtypes)[c])).createOrReplaceTempView(t)
        others = [x for x in spark.sql(sql).columns if x not in outputs]
        views(spark, SF, tables.split())
        kept = rows(spark.sql(sql).select(*others)) if others else []
        df.withColumn(c, F.lit(None).cast(dict(df.dtypes)[c])).createOrReplaceTempView(t)
        assert not others or rows(spark.sql(sql).select(*others)) == kept, (t, c)
        views(spark, SF, tables.split())


# -- states


def test_effects_and_states(spark):
    script = """INSERT INTO m.t SELECT a FROM s; INSERT OVERWRITE TABLE m.t SELECT a FROM m.t; INSERT OVERWRITE TABLE m.t PARTITION (dt) SELECT a, dt FROM s;
        SET spark.sql.sources.partitionOverwriteMode=dynamic; INSERT OVERWRITE TABLE m.t PARTITION (dt) SELECT a, dt FROM s; DELETE FROM m.t; DELETE FROM m.t WHERE a = 1; TRUNCATE TABLE m.t PARTITION (dt='1')"""
    f = analyze(spark, [("t", script)])
    got = states.states(f).orderBy("ordinal").collect()
    assert [r.effect for r in got] == ["APPEND", "REPLACE", "REPLACE", "REPLACE_PARTITION", "RESET", "ANTI_FILTER", "RESET_PARTITION"]
    assert [r.overwrite_mode_source for r in got[1:4]] == ["assumed_default", "assumed_default", "observed"]
    assert [r.previous for r in got] == [None, None, None, "state:m.t:003", None, "state:m.t:005", "state:m.t:006"]
    seen = {(r.stmt, r.source): r.source_state for r in states.reads(f).collect()}
    assert seen[("stmt:002", "m.t")] == "state:m.t:001" and seen[("stmt:001", "s")] is None


def test_fold_stops_at_its_limit_with_a_reason(spark):
    chain = "CREATE TEMPORARY VIEW v0 AS SELECT a FROM base;" + "".join(f"CREATE TEMPORARY VIEW v{i} AS SELECT a FROM v{i - 1};" for i in range(1, 6)) + "INSERT INTO m.t SELECT a FROM v5"
    f = analyze(spark, [("t", chain)])
    assert [(r.source, r.source_column, r.reason) for r in states.fold_sessions(f).collect()] == [("base", "a", None)]
    cut = states.fold_sessions(f, limit=2).collect()
    assert [(r.source, r.reason) for r in cut] == [("v3", "fold_depth_exceeded")]


# -- audits


def test_binding_statuses(spark):
    cols = spark.createDataFrame([("m.t", 0, "p"), ("m.t", 1, "q"), ("m.t", 2, "dt")], "relation string, ordinal int, column string")
    f = analyze(spark, [("t", "INSERT INTO m.t PARTITION (dt='1') SELECT a, b FROM s; INSERT INTO m.t SELECT a FROM s; INSERT INTO m.u SELECT a FROM s")])
    got = audit.target_binding(f, cols).orderBy("stmt", "ordinal").collect()
    assert [(r.target_column, r.status) for r in got] == [("p", "applied"), ("q", "applied"), ("a", "fallback"), ("a", "metadata_not_provided")]


def test_gate_and_quality(spark):
    f = analyze(spark, [("good", "INSERT INTO m.t SELECT a FROM s"), ("bad", "DROP TABLE x; INSERT INTO m.t SELECT a FROM s -- TODO fixme"), ("star", "INSERT INTO m.t SELECT * FROM s")])
    passed = {level: {r.task for r in audit.quality_gate(f, level).filter("passed").collect()} for level in ("permissive", "balanced", "strict")}
    assert passed == {"permissive": {"good", "bad", "star"}, "balanced": {"good", "star"}, "strict": {"good"}}
    with pytest.raises(ValueError):
        audit.quality_gate(f, "lenient")
    assert [(r.task, r.marks) for r in audit.raw_quality(f).collect()] == [("bad", "FIXME,TODO")]
    declared = spark.createDataFrame([("good", "s"), ("good", "gone")], "task string, source string")
    assert rows(audit.source_coverage(f.__class__({**f.tables, "inputs": f.inputs.filter("task = 'good'")}), declared)) == [("good", "gone", "declared_not_read"), ("good", "s", "covered")]


def test_documents_are_checked_and_repeatable(spark, tmp_path):
    f = corpus.facts(spark)
    assert publish.violations(f).isEmpty()
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    publish.write(f, one)
    publish.write(corpus.facts(spark), two)
    for part in ("lineage", "task_lineage"):
        assert sorted(r.value for r in spark.read.text(f"{one}/{part}").collect()) == sorted(r.value for r in spark.read.text(f"{two}/{part}").collect())
    doc = next(d for d in (json.loads(r.value) for r in spark.read.text(f"{one}/lineage").collect()) if d["task"] == "revenue")
    assert doc["schema_version"] == "1.0" and {e["column"]: sorted(p["source_column"] for p in e["physical"]) for e in doc["end_to_end"]}["revenue"] == ["l_discount", "l_extendedprice"]
    assert spark.read.parquet(f"{one}/facts/statements").count() == f.statements.count()
    broken = f.__class__({**f.tables, "scopes": f.scopes.filter("scope <> 'cte:priced'")})
    with pytest.raises(publish.InvalidFacts):
        publish.write(broken, str(tmp_path / "three"))
    assert not os.path.exists(tmp_path / "three")


def test_markdown(spark):
    f = corpus.facts(spark)
    text = {(r.task, r.stmt): r.markdown for r in publish.mapping_markdown(f).collect()}
    m = text[("revenue", "stmt:001")]
    assert m.startswith("---\ndoc_format: mapping") and [x for x in m.split("\n") if x.startswith("## ")] == ["## Overview", "## Sources", "## Mapping", "## Steps", "## Logic", "## Graph", "## Profile", "## Gaps"]
    assert "- revenue <- lineitem.l_discount, lineitem.l_extendedprice" in m and "- cte:priced -> ROOT" in m
    warned = {r.task: r.markdown for r in publish.warnings_markdown(f).collect()}
    assert "revenue" not in warned and "## star_not_expanded" in warned["upkeep"]


# -- functions


def test_expression_functions(spark):
    df = spark.createDataFrame([("  Sum(A)  + 1 ", ["DIRECT", "WINDOW", "UNION"], ["dt", "DS"])], "t string, k array<string>, f array<string>")
    got = df.select(E.fingerprint(F.lit("aggregate"), F.col("t")).alias("a"), E.dominant(F.col("k")).alias("d"), E.is_partition_filter(F.col("f")).alias("p"), E.called_functions(F.lit("Upper(cast(x)) + sum(IF(a, b))")).alias("c"), E.transform_rank(F.lit("none")).alias("n")).first()
    assert (got.a, got.d, got.p, got.c, got.n) == ("aggregate:sum(a) + 1", "WINDOW", True, ["sum", "upper"], None)


# -- readers


def test_csv_metadata(spark, tmp_path):
    one = tmp_path / "a.csv"
    one.write_text("table_name,column_name,data_type,comment\ncat.DB.T,ID,int,\"the, id\"\ndb.t,Name,string,\ndb.t,id,bigint,again\n")
    got = metadata.read_csv(spark, str(one)).orderBy("relation", "ordinal").collect()
    # whole names are kept apart; a lookup tries them before their last two parts
    assert [(r.relation, r.ordinal, r.column, r.type, r.comment) for r in got] == [("cat.db.t", 0, "id", "int", "the, id"), ("db.t", 0, "name", "string", None), ("db.t", 1, "id", "bigint", "again")]
    tab = tmp_path / "b.tsv"
    tab.write_text("table\tfield\tdescription\ndb.u\tx\tfirst, second\n")
    assert metadata.read_csv(spark, str(tab)).first().comment == "first, second"
    nul = tmp_path / "c.csv"
    nul.write_text("table,column\ndb.u,x\x00y\n")
    with pytest.raises(metadata.MetadataFileError):
        metadata.read_csv(spark, str(nul))
    assert metadata.read_csv(spark, str(nul), nul="remove").first().column == "xy"
    bad = tmp_path / "d.csv"
    bad.write_text("p,q\n1,2\n")
    with pytest.raises(metadata.MetadataFileError):
        metadata.read_csv(spark, str(bad))


def fields(*names, **more):
    return [dict(name=n, **more) for n in names]


SHAPES = [
    {"DB.t": list("ab")},
    {"db.t": fields("A", type="int") + fields("b")},
    {"db.t": {"column_details": fields("a") + fields("b", comment="c")}},
    {"tables": [dict(table_name="db.t", schema=fields("a", "b"))]},
    dict(table_name="x.db.t", schema=fields("a", type="int") + fields("b")),
    [dict(table_name="db.t", column_name="a"), dict(table="db.t", column="b")],
]


@pytest.mark.parametrize("content", SHAPES)
def test_json_metadata(spark, tmp_path, content):
    (tmp_path / "m.json").write_text(json.dumps(content))
    (tmp_path / "broken.json").write_text("{not json")
    got = metadata.read_json(spark, str(tmp_path)).orderBy("ordinal").collect()
    name = content["table_name"] if "table_name" in content else "db.t"  # whole names are kept
    assert [(r.relation, r.ordinal, r.column) for r in got] == [(name, 0, "a"), (name, 1, "b")]


def test_json_metadata_needs_one_good_file(spark, tmp_path):
    (tmp_path / "broken.json").write_text("{not json")
    with pytest.raises(metadata.MetadataFileError):
        metadata.read_json(spark, str(tmp_path)).count()


def test_merge_latest_and_ddl(spark):
    shape = lambda data: spark.createDataFrame([(t, i, c, None, None, o) for t, cs, o in data for i, c in enumerate(cs)], metadata.SHAPE)
    chosen, conflicts = metadata.merge([shape([("db.t", ["a", "b"], "one")]), shape([("db.t", ["a", "c"], "two"), ("db.u", ["x"], "two")]), shape([("db.t", ["a", "b"], "three")])])
    assert metadata.as_schema(chosen) == {"db.t": ["a", "b"], "db.u": ["x"]}
    assert [(r.relation, r.origin, r.ignored) for r in conflicts.collect()] == [("db.t", "two", ["a", "c"])]
    times = "relation string, query_time string, ddl_update_time string, n int"
    assert metadata.latest(spark.createDataFrame([("t", "2024-01-01", None, 1), ("t", "2024-02-01", None, 2), ("u", None, None, 3)], times)).orderBy("n").select("n").collect() == [(2,), (3,)]
    for unclear in ([("t", "2024-01-01", None, 1), ("t", "2024-01-01", None, 2)], [("t", "2024-01-01", None, 1), ("t", None, None, 2)]):
        with pytest.raises(metadata.MetadataFileError):
            metadata.latest(spark.createDataFrame(unclear, times))
    ddl = "CREATE TABLE db.t (a DOUBLE COMMENT 'first', not DOUBLE, `b c` MAP<STRING, INT>) USING parquet PARTITIONED BY (dt STRING)"
    got = metadata.ddl_columns(spark, ddl)
    assert [(c[0], c[3]) for c in got] == [("a", False), ("not", False), ("b c", False), ("dt", True)] and got[0][1:3] == ("double", "first")
    assert metadata.target_columns(spark, {"db.t": ddl}).count() == 4
    with pytest.raises(metadata.MetadataFileError):
        metadata.ddl_columns(spark, "SELECT 1")
    spark.range(1).selectExpr("id", "'x' AS name").createOrReplaceTempView("seen_view")
    assert metadata.as_schema(metadata.from_catalog(spark, ["seen_view", "unseen_view"])) == {"seen_view": ["id", "name"]}
    used = spark.createDataFrame([("cat.db.t", "B")], "source string, field string")
    assert [r.column for r in metadata.related(chosen, used).collect()] == ["b"]


def test_script_readers(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "one.sql").write_text("SELECT 1;\nSELECT 2")
    put = lambda where, **content: where.write_text(json.dumps(content))
    put(tmp_path / "a.json", meta=dict(sql="SELECT 1", task_name="alpha", upstream_tasks=[dict(task_name="u", task_id="7"), dict(task_name="v")]), query_time="x")
    put(tmp_path / "sub" / "b.json", task_name="alpha", sql="SELECT 2")
    (tmp_path / "c.json").write_text("{oops")
    put(tmp_path / "d.json", meta=dict(task_name="empty"))
    assert [(r.task, r.sql) for r in scripts.sql_files(spark, str(tmp_path)).collect()] == [("one", "SELECT 1;\nSELECT 2")]
    read = scripts.tasks(spark, str(tmp_path))
    assert sorted((r.task, r.error) for r in read.collect() if r.error) == [("c", "invalid_json"), ("empty", "no_sql")]
    assert scripts.readable(spark, str(tmp_path)).count() == 2
    assert [(r.dependency, r.other_task) for r in scripts.task_dependencies(read).orderBy("dependency").collect()] == [("taskdep:upstream:001", "u"), ("taskdep:upstream:002", "v")]
    assert [r.task for r in scripts.collisions(read).collect()] == ["alpha"]
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "x.json").write_text("{}")
    with pytest.raises(scripts.EmptySource):
        scripts.readable(spark, str(tmp_path / "none"))


def test_streamed_scripts(spark, tmp_path):
    from loomtrace.streaming.ingest import watch

    inbox = tmp_path / "in"
    inbox.mkdir()
    for step, table in enumerate(("s", "u")):
        (inbox / f"{step}.json").write_text(json.dumps({"task_name": f"job{step}", "sql": f"INSERT INTO m.t SELECT a FROM {table}"}) + "\n")
        watch(spark, str(inbox), str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out" / "end_to_end")).selectExpr("task", "physical[0].source AS source").collect()
    assert sorted((r.task, r.source) for r in got) == [("job0", "s"), ("job1", "u")]

"""Every registered query that has SQL of its own against that SQL in DuckDB."""

import datetime
import glob
import math
import os
import random
from collections import Counter
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__
from loomtrace.plans import query_pack
from loomtrace.session import views

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM read_parquet('{files}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, Decimal):
        return round(float(v), 6)
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, int):
        return float(v)
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return str(v.replace(tzinfo=None)) if isinstance(v, datetime.datetime) else str(v)


@pytest.mark.parametrize("name", sorted(__spark_entry__.oracle_sql()))
def test_same_rows(spark, duck, name):
    got = __spark_entry__.queries()[name](spark, SF)
    want = duck.execute(__spark_entry__.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    order = sorted(names)
    theirs = sorted((str([plain(dict(zip(names, r))[c]) for c in order]) for r in want.fetchall()))
    ours = sorted(str([plain(r[c]) for c in order]) for r in got.collect())
    assert ours == theirs


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 5


def test_every_query_over_tables_reads_them_whole(spark):
    """No limit, sample or condition on ids stands between a table and a query of the pack: the plan's scans carry no such filter."""
    for name, (tables, text, _) in query_pack.PACK.items():
        plan = __spark_entry__.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert "Sample " not in plan and "pmod" not in plan, name
        assert "GlobalLimit" not in plan or "LIMIT" in text.upper(), name
        for table in tables.split():
            assert f"{table}.parquet" in __spark_entry__.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString(), (name, table)


def test_oracles_name_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_range_join_does_not_compare_every_pair(spark):
    """Without this, seconds grow with the product of the tables; the scans stay whole."""
    plan = __spark_entry__.queries()["q_j7_range"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "NestedLoop" not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("kind", ["double", "decimal(12,2)"])
def test_range_join_on_odd_values(spark, tmp_path, kind):
    """Edges of ranges, values that are no number or have no neighbours, repeated rows and keys, one crowded bin, empty tables; held against the statement's own plan."""
    rng = random.Random(7)
    odd = [None, 0.0, -0.0, 25.0, -25.0, 900.0, 924.99, 925.0, 899.99, 6.25, 6.249999999999999, 0.1 + 0.2] + ([math.nan, math.inf, -math.inf, 1e17, 9e18, -9e18, 1e300, 5e-324, 2.0**57 + 32] if kind == "double" else [])
    p = [*odd, *odd, *[900.0] * 40, *[round(rng.uniform(-40, 40), 2) for _ in range(60)], *[x + 25 for x in odd if x is not None]]
    s = [*odd, *odd, *[890.0] * 30, *[round(rng.uniform(-60, 60), 2) for _ in range(60)], *[x - 25 for x in odd if x is not None]]
    for name, size in (("some", None), ("none", 0)):
        spark.createDataFrame([(None if i % 7 == 0 else i // 2, x) for i, x in enumerate(p)][:size], "p_partkey long, x double").selectExpr("p_partkey", f"CAST(x AS {kind}) AS p_retailprice").write.parquet(f"{tmp_path}/{name}/part.parquet")
        spark.createDataFrame([(None if i % 7 == 0 else i // 2, x) for i, x in enumerate(s)], "s_suppkey long, x double").selectExpr("s_suppkey", f"CAST(x AS {kind}) AS s_acctbal").write.parquet(f"{tmp_path}/{name}/supplier.parquet")
        got = __spark_entry__.queries()["q_j7_range"](spark, f"{tmp_path}/{name}")
        want = spark.sql(query_pack.PACK["q_j7_range"][1])
        assert got.schema == want.schema
        rows = Counter(map(tuple, want.collect()))
        assert bool(rows) == (name == "some") and Counter(map(tuple, got.collect())) == rows
        for width, most in ((6.25, 2), (0.7, 5), (1000.0, 3)) if kind == "double" else ():
            assert Counter(map(tuple, query_pack.range_join(spark, width, most).collect())) == rows, (width, most)


def test_crowded_bins_are_split_on_both_sides(spark, tmp_path):
    """One price and one balance for all: no key of the join holds many rows of a side."""
    spark.range(3000).selectExpr("id AS p_partkey", "900.0D AS p_retailprice").write.parquet(f"{tmp_path}/part.parquet")
    spark.range(2000).selectExpr("id AS s_suppkey", "890.0D AS s_acctbal").write.parquet(f"{tmp_path}/supplier.parquet")
    views(spark, str(tmp_path), ["part", "supplier"])
    left, right = query_pack.range_sides(spark.table("part"), spark.table("supplier"), most=100)
    for side in (left, right):
        assert side.groupBy("bin", "a", "b").count().agg({"count": "max"}).first()[0] < 200
    assert (left.count(), right.filter("bin = 144").count()) == (3000 * 20, 2000 * 30)
    assert query_pack.range_join(spark, most=100).distinct().count() == 3000 * 2000

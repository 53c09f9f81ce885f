"""The SQL constructs that the analyzer reads, as runnable queries with a twin for an independent engine.

``PACK`` maps a name to ``(tables, Spark SQL, DuckDB SQL or None where both engines read the same text)``.
Every statement covers its whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from loomtrace.session import views

PACK: dict[str, tuple[str, str, str | None]] = {
    # projections, filters, predicates
    "q_p1_project_filter": ("lineitem", "SELECT l_orderkey, l_linenumber, l_quantity * 2 AS double_quantity FROM lineitem WHERE l_quantity > 30", None),
    "q_p5_case_if": ("orders", "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'middle' ELSE 'low' END AS tier, IF(o_orderstatus = 'F', 1, 0) AS finished FROM orders", "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'middle' ELSE 'low' END AS tier, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS finished FROM orders"),
    "q_p6_constants": ("region", "SELECT r_regionkey, 'fixed' AS label, 7 AS seven FROM region", None),
    "q_p8_star": ("nation region", "SELECT n.*, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey", None),
    "q_p12_star_except": ("orders", "SELECT * EXCEPT (o_orderpriority, o_orderdate) FROM orders", "SELECT * EXCLUDE (o_orderpriority, o_orderdate) FROM orders"),
    "q_p15_multi_alias": ("events", "SELECT event_id, posexplode(split(event_type, '_')) AS (spot, part) FROM events", "SELECT event_id, unnest(range(len(string_split(event_type, '_')))) ::INT AS spot, unnest(string_split(event_type, '_')) AS part FROM events"),
    "q_p16_where_having": ("lineitem", "SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_suppkey HAVING count(*) > 5", None),
    "q_p17_conjuncts": ("lineitem", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount BETWEEN 0.02 AND 0.05 AND l_quantity < 20 AND (l_returnflag = 'A' OR l_linestatus = 'O') AND l_partkey IS NOT NULL", None),
    "q_p19_exists": ("customer orders", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)", None),
    "q_p19_not_exists": ("customer orders", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)", None),
    "q_p19_in": ("supplier nation", "SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 2)", None),
    "q_p21_distinct": ("orders", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders", None),
    "q_f17_scalar_subquery": ("orders", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 0.9 * (SELECT max(o_totalprice) FROM orders)", None),
    "q_b10_correlated_value": ("customer orders", "SELECT c_custkey, (SELECT max(o.o_totalprice) FROM orders o WHERE o.o_custkey = c.c_custkey) AS best FROM customer c", None),
    # joins
    "q_j1_inner": ("orders customer", "SELECT o.o_orderkey, c.c_mktsegment FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey", None),
    "q_j1_comma": ("nation region", "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey", None),
    "q_j1_using": ("orders lineitem", "SELECT k, o_totalprice, l_quantity FROM (SELECT o_orderkey AS k, o_totalprice FROM orders) JOIN (SELECT l_orderkey AS k, l_quantity FROM lineitem) USING (k)", "SELECT k, o_totalprice, l_quantity FROM (SELECT o_orderkey AS k, o_totalprice FROM orders) a JOIN (SELECT l_orderkey AS k, l_quantity FROM lineitem) b USING (k)"),
    "q_j2_left_outer": ("customer orders", "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_totalprice > 200000", None),
    "q_j2_right_outer": ("customer orders", "SELECT c.c_custkey, o.o_orderkey FROM orders o RIGHT JOIN customer c ON o.o_custkey = c.c_custkey", None),
    "q_j2_full_outer": ("supplier customer", "SELECT s.s_suppkey, c.c_custkey FROM supplier s FULL JOIN customer c ON s.s_suppkey = c.c_custkey", None),
    "q_j3_cross": ("nation region", "SELECT n_name, r_name FROM nation CROSS JOIN region", None),
    "q_j4_semi": ("customer orders", "SELECT c_custkey FROM customer LEFT SEMI JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F'", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')"),
    "q_j4_anti": ("customer orders", "SELECT c_custkey FROM customer LEFT ANTI JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F'", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')"),
    "q_j5_self": ("nation", "SELECT a.n_name AS one, b.n_name AS other FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey", None),
    "q_j7_range": ("part supplier", "SELECT p_partkey, s_suppkey FROM part JOIN supplier ON p_retailprice BETWEEN s_acctbal AND s_acctbal + 25", None),
    "q_j6_multi_key": ("orders lineitem customer nation", "SELECT n.n_name, round(sum(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name", None),
    # aggregation
    "q_a1_group": ("lineitem", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus", None),
    "q_a2_ordinal": ("orders", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1", None),
    "q_a4_distinct": ("lineitem", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_returnflag", None),
    "q_a5_known_aggregates": ("orders", "SELECT o_orderstatus, min(o_totalprice) AS lo, max(o_totalprice) AS hi, count_if(o_totalprice > 100000) AS big, size(collect_set(o_orderpriority)) AS kinds FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, min(o_totalprice) AS lo, max(o_totalprice) AS hi, CAST(count_if(o_totalprice > 100000) AS BIGINT) AS big, CAST(count(DISTINCT o_orderpriority) AS INTEGER) AS kinds FROM orders GROUP BY o_orderstatus"),
    "q_a6_percentile": ("orders", "SELECT o_orderstatus, round(percentile(o_totalprice, 0.5), 4) AS middle FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, round(quantile_cont(o_totalprice, 0.5), 4) AS middle FROM orders GROUP BY o_orderstatus"),
    "q_a7_count_star": ("events", "SELECT count(*) AS n, count(1) AS n1 FROM events", None),
    "q_a8_struct_aggregate": ("events", "SELECT user_id, max(struct(ts, event_id, value)).value AS last_value FROM events GROUP BY user_id", "SELECT user_id, arg_max(value, (ts, event_id)) AS last_value FROM events GROUP BY user_id"),
    "q_a9_aggregate_case": ("orders", "SELECT o_custkey, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS finished FROM orders GROUP BY o_custkey", "SELECT o_custkey, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS finished FROM orders GROUP BY o_custkey"),
    "q_a10_having": ("orders", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) >= 12", None),
    "q_ext_cube": ("customer", "SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY CUBE (c_nationkey, c_mktsegment)", None),
    "q_ext_rollup": ("customer", "SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ROLLUP (c_nationkey, c_mktsegment)", None),
    "q_ext_grouping_sets": ("customer", "SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY GROUPING SETS ((c_nationkey), (c_mktsegment), ())", None),
    # windows
    "q_w1_row_number": ("orders", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM orders", "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS INTEGER) AS rn FROM orders"),
    "q_w1_rank": ("part", "SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS r, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS d FROM part", "SELECT p_partkey, CAST(rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS INTEGER) AS r, CAST(dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS INTEGER) AS d FROM part"),
    "q_w1_sum_over": ("lineitem", "SELECT l_orderkey, l_linenumber, round(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber), 2) AS running FROM lineitem", None),
    "q_w2_lag_lead": ("events", "SELECT event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS after FROM events", None),
    "q_w5_dedup": ("events", "SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1", "SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) q WHERE rn = 1"),
    "q_ext_frame": ("orders", "SELECT o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS smooth FROM orders", None),
    # sort, limit
    "q_o1_order_limit": ("orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10", None),
    # set operations
    "q_u1_union_all": ("customer supplier", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier", None),
    "q_u1_union": ("customer supplier", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier", None),
    "q_u2_three_branches": ("customer supplier nation", "SELECT c_nationkey AS k, 'c' AS t FROM customer UNION ALL SELECT s_nationkey, 's' FROM supplier UNION ALL SELECT n_nationkey, 'n' FROM nation", None),
    "q_ext_intersect": ("customer supplier", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier", None),
    "q_ext_except": ("nation supplier", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier", None),
    # functions, generators, pivot, nested types
    "q_f2_cleaning": ("customer", "SELECT c_custkey, coalesce(nullif(trim(c_mktsegment), ''), 'none') AS segment, replace(c_name, '#', '-') AS name, substr(c_name, 1, 4) AS head, regexp_replace(c_name, '[0-9]+', 'N') AS masked FROM customer", "SELECT c_custkey, coalesce(nullif(trim(c_mktsegment), ''), 'none') AS segment, replace(c_name, '#', '-') AS name, substr(c_name, 1, 4) AS head, regexp_replace(c_name, '[0-9]+', 'N', 'g') AS masked FROM customer"),
    "q_f3_string": ("customer", "SELECT c_custkey, upper(c_name) AS u, lower(c_mktsegment) AS l, length(c_name) AS n, concat(c_name, '/', c_mktsegment) AS c, concat_ws('-', c_name, c_mktsegment) AS w, left(c_name, 3) AS a, right(c_name, 3) AS z, md5(c_name) AS m, sha2(c_name, 256) AS s, regexp_extract(c_name, '([0-9]+)', 1) AS digits FROM customer", "SELECT c_custkey, upper(c_name) AS u, lower(c_mktsegment) AS l, CAST(length(c_name) AS INTEGER) AS n, concat(c_name, '/', c_mktsegment) AS c, concat_ws('-', c_name, c_mktsegment) AS w, left(c_name, 3) AS a, right(c_name, 3) AS z, md5(c_name) AS m, sha256(c_name) AS s, regexp_extract(c_name, '([0-9]+)', 1) AS digits FROM customer"),
    "q_f4_date": ("orders", "SELECT o_orderkey, to_date(o_orderdate) AS d, date_add(to_date(o_orderdate), 30) AS due, datediff(DATE '2000-01-01', to_date(o_orderdate)) AS days, date_format(o_orderdate, 'yyyy-MM') AS month, year(o_orderdate) AS y FROM orders", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CAST(o_orderdate AS DATE) + 30 AS due, CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2000-01-01') AS INTEGER) AS days, strftime(o_orderdate, '%Y-%m') AS month, CAST(year(o_orderdate) AS INTEGER) AS y FROM orders"),
    "q_f5_math": ("supplier", "SELECT s_suppkey, abs(s_acctbal) AS a, CAST(ceil(s_acctbal) AS BIGINT) AS c, CAST(floor(s_acctbal) AS BIGINT) AS f, greatest(s_acctbal, 0.0D) AS g, least(s_acctbal, 0.0D) AS l FROM supplier", "SELECT s_suppkey, abs(s_acctbal) AS a, CAST(ceil(s_acctbal) AS BIGINT) AS c, CAST(floor(s_acctbal) AS BIGINT) AS f, greatest(s_acctbal, CAST(0.0 AS DOUBLE)) AS g, least(s_acctbal, CAST(0.0 AS DOUBLE)) AS l FROM supplier"),
    "q_f10_explode": ("embeddings", "SELECT vec_id, round(sum(CAST(x AS DOUBLE)), 4) AS total FROM (SELECT vec_id, explode(embedding) AS x FROM embeddings) GROUP BY vec_id", "SELECT vec_id, round(sum(CAST(x AS DOUBLE)), 4) AS total FROM (SELECT vec_id, unnest(embedding) AS x FROM embeddings) q GROUP BY vec_id"),
    "q_f11_lateral_view": ("embeddings", "SELECT e.vec_id, v.spot, v.x FROM embeddings e LATERAL VIEW posexplode(e.embedding) v AS spot, x WHERE v.spot < 3", "SELECT vec_id, CAST(spot - 1 AS INTEGER) AS spot, embedding[spot] AS x FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS spot FROM embeddings) q WHERE spot <= 3"),
    "q_f14_pivot": ("orders", "SELECT * FROM (SELECT o_orderpriority, o_orderstatus, o_orderkey FROM orders) PIVOT (count(o_orderkey) FOR o_orderstatus IN ('F' AS f, 'O' AS o, 'P' AS p))", "SELECT o_orderpriority, count(o_orderkey) FILTER (o_orderstatus = 'F') AS f, count(o_orderkey) FILTER (o_orderstatus = 'O') AS o, count(o_orderkey) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY 1"),
    "q_f16_lambda": ("embeddings", "SELECT vec_id, size(filter(embedding, x -> x > 0)) AS positive, round(aggregate(transform(embedding, x -> CAST(x AS DOUBLE) * x), 0.0D, (a, x) -> a + x), 3) AS norm FROM embeddings", "SELECT vec_id, CAST(len(list_filter(embedding, lambda x: x > 0)) AS INTEGER) AS positive, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 3) AS norm FROM embeddings"),
    "q_f12_from_json": ("events", "SELECT event_id, from_json(props, 'k INT, page STRING').k AS k FROM events", "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events"),
    # statements whose effect is a pure query
    "q_t6_merge_effect": ("customer orders", "SELECT coalesce(c.c_custkey, s.k) AS k, CASE WHEN s.k IS NULL THEN 'kept' WHEN c.c_custkey IS NULL THEN 'inserted' ELSE 'updated' END AS what, coalesce(s.n, 0) AS n FROM customer c FULL JOIN (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey) s ON c.c_custkey = s.k", None),
    "q_t11_delete_effect": ("orders", "SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F' AND o_totalprice < 50000)", None),
    "q_t13_update_effect": ("supplier", "SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 0.0D ELSE s_acctbal END AS s_acctbal FROM supplier", "SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN CAST(0.0 AS DOUBLE) ELSE s_acctbal END AS s_acctbal FROM supplier"),
}

#: The flagship: revenue by market segment, whose lineage the tests trace as well.
REVENUE = """
    WITH priced AS (SELECT l_orderkey, l_extendedprice * (1 - l_discount) AS net FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01')
    SELECT c.c_mktsegment, round(sum(p.net), 2) AS revenue
    FROM priced p JOIN orders o ON p.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
    GROUP BY c.c_mktsegment"""
PACK["q_revenue_by_segment"] = ("lineitem orders customer", REVENUE, None)


def _chunked(side: DataFrame, mine: str, other: str, mine_many: DataFrame, other_many: DataFrame) -> DataFrame:
    """Rows of ``side`` with their chunk of a crowded bin in ``mine``, once for each chunk of the other side in ``other``."""
    one = F.lit(1).cast("bigint")
    return (
        side.join(F.broadcast(mine_many.withColumnRenamed("chunks", "m")), "bin", "left").join(F.broadcast(other_many.withColumnRenamed("chunks", "o")), "bin", "left")
        .withColumn(mine, F.shiftrightunsigned(F.xxhash64("nth"), 1) % F.coalesce("m", one) + 1).withColumn(other, F.explode(F.sequence(one, F.coalesce("o", one)))).drop("nth", "m", "o")
    )


def range_sides(part: DataFrame, supplier: DataFrame, width: float = 6.25, most: int = 4096) -> tuple[DataFrame, DataFrame]:
    """Both sides of the join of :func:`range_join` with its key ``bin, a, b``: each pair within a range meets at one key."""
    at = lambda value: F.floor(F.expr(value) / width)
    nth = F.monotonically_increasing_id()
    parts = part.select("p_partkey", "p_retailprice").filter("p_retailprice IS NOT NULL").withColumn("nth", nth).withColumn("bin", at("p_retailprice"))
    ranges = supplier.select("s_suppkey", "s_acctbal").filter("s_acctbal IS NOT NULL").withColumn("nth", nth).withColumn("bin", F.explode(F.sequence(at("s_acctbal"), at("s_acctbal + 25"))))
    many_p, many_r = (df.groupBy("bin").agg(F.ceil(F.count("*") / most).alias("chunks")).filter("chunks > 1") for df in (parts, ranges))
    return _chunked(parts, "a", "b", many_p, many_r), _chunked(ranges, "b", "a", many_r, many_p)


def range_join(spark: SparkSession, width: float = 6.25, most: int = 4096) -> DataFrame | None:
    """The rows of ``q_j7_range`` without comparing every pair: a join on bins of prices, then the statement's own condition.

    The bin of a number never falls as the number grows, so a price within a range lies in one of the bins from the
    range's start to its end, and in one only.  A bin of more than ``most`` rows of a side is split into
    chunks of that side, each of which meets every chunk of the other: a key of the join has about ``most`` rows a
    side whatever the values, and the tables that are broadcast have a row for each such bin alone.  Nothing for
    columns that are no doubles: how others are compared need not follow the order of bins.
    """
    part, supplier = spark.table("part"), spark.table("supplier")
    if {x.dataType for x in (*part.select("p_retailprice").schema, *supplier.select("s_acctbal").schema)} != {DoubleType()}:
        return None
    left, right = range_sides(part, supplier, width, most)
    return left.join(right.hint("merge"), ["bin", "a", "b"]).filter("p_retailprice BETWEEN s_acctbal AND s_acctbal + 25").select("p_partkey", "s_suppkey")


#: Plans for statements that Spark would run by comparing every pair of rows; nothing where the text itself is to be run.
PLANS: dict[str, Callable[[SparkSession], DataFrame | None]] = {"q_j7_range": range_join}


def run(name: str) -> Callable[[SparkSession, str], DataFrame]:
    tables, text, _ = PACK[name]

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        views(spark, sf_dir, tables.split())
        planned = PLANS[name](spark) if name in PLANS else None
        return spark.sql(text) if planned is None else planned

    return query


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run(name) for name in PACK}


def oracle_sql() -> dict[str, str]:
    return {name: twin or text for name, (_, text, twin) in PACK.items()}

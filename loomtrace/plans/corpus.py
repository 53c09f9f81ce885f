"""A fixed corpus of scripts over the driver's tables, on which the fact queries run, and its table metadata."""

from __future__ import annotations

from pyspark.sql import SparkSession

from loomtrace.plans.facts import Facts, analyze

#: Columns of the source tables, as Parquet has them, and of two targets.
SCHEMA = {
    "region": ["r_regionkey", "r_name"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"],
    "events": ["event_id", "ts", "user_id", "event_type", "value", "props"],
    "mart.revenue_by_segment": ["segment", "revenue"],
    "mart.customer_daily": ["custkey", "name", "orders", "dt"],
}

SCRIPTS = {
    "revenue": """
        -- revenue of each market segment
        INSERT OVERWRITE TABLE mart.revenue_by_segment
        WITH priced AS (SELECT l_orderkey, l_extendedprice * (1 - l_discount) AS net FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01')
        SELECT c.c_mktsegment, SUM(p.net) AS revenue
        FROM priced p JOIN orders o ON p.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
        GROUP BY c.c_mktsegment;
    """,
    "daily": """
        SET spark.sql.sources.partitionOverwriteMode=dynamic;
        CREATE TEMPORARY VIEW recent AS SELECT o_custkey, o_orderkey, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01';
        CACHE TABLE counted AS SELECT o_custkey AS k, count(*) AS n, max(o_totalprice) AS best FROM recent GROUP BY o_custkey;;
        INSERT OVERWRITE TABLE mart.customer_daily PARTITION (dt = '2024-01-01')
        SELECT c.c_custkey, c.c_name, coalesce(t.n, 0) AS n FROM customer c LEFT JOIN counted t ON c.c_custkey = t.k;
        INSERT INTO mart.all_keys SELECT c_custkey AS k FROM customer UNION ALL SELECT s_suppkey FROM supplier;
        INSERT INTO mart.all_keys SELECT l_partkey FROM lineitem;
        /* nothing follows */
    """,
    "upkeep": """
        MERGE INTO mart.balance t USING (SELECT c_custkey AS id, c_acctbal AS amount FROM customer) s ON t.id = s.id
            WHEN MATCHED AND s.amount < 0 THEN DELETE
            WHEN MATCHED THEN UPDATE SET amount = t.amount + s.amount
            WHEN NOT MATCHED THEN INSERT (amount, id) VALUES (s.amount, s.id);
        UPDATE mart.balance SET amount = 0 WHERE amount < 0.5;
        DELETE FROM mart.balance WHERE id IS NULL;
        TRUNCATE TABLE mart.staging;
        CREATE TABLE mart.latest AS
            SELECT user_id, event_type FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS rn FROM events) q WHERE rn = 1;
        INSERT INTO mart.guess SELECT name, x.label FROM somewhere x JOIN elsewhere y ON x.id = y.id;
        INSERT INTO mart.wide SELECT * FROM somewhere;
        DROP TABLE mart.old;
        SELEC 1;
    """,
}

#: Columns of relations that no script writes completely.
EXTRA = {"mart.balance": ["id", "amount"]}


def facts(spark: SparkSession) -> Facts:
    return analyze(spark, SCRIPTS.items(), SCHEMA | EXTRA)

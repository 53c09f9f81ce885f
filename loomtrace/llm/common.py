"""Shared plumbing: input normalisation, lineage cuts, shared files, row choice, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def checkpoint_ready(spark: SparkSession) -> str:
    """The shared checkpoint folder, read from ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder stands in on a local master alone; on a cluster, whose
    executors share no such folder, it is an error.
    """
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="loomtrace-ckpt-"))
    return sc._jsc.sc().getCheckpointDir().get()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below the shared checkpoint folder."""
    return f"{checkpoint_ready(spark)}/{name}-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate data; nothing where it is gone already."""
    fs, p = _file_system(spark, path)
    fs.delete(p, True)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none where it does not exist."""
    fs, p = _file_system(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably in the shared checkpoint folder and return it without lineage."""
    checkpoint_ready(df.sparkSession)
    return df.checkpoint(eager=True)


def keyed(df: DataFrame, key: str, *cols: str | Column) -> DataFrame:
    """The named columns only, without rows whose key is null or no whole number (they cannot be named in a result)."""
    number = F.col(key).try_cast("bigint")
    return df.select(number.alias(key), *[F.col(c) if isinstance(c, str) else c for c in cols]).filter(F.col(key).isNotNull())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have."""
    taken, name, n = {c.lower() for c in df.columns}, base, 1
    while name in taken:
        name, n = f"{base}_{n}", n + 1
    return name


def tag(text: str | Column = "text") -> Column:
    """Tells apart the texts of one id; nothing else is compared by it."""
    return F.xxhash64(text)


def without(docs: DataFrame, gone: DataFrame, by_text: bool) -> DataFrame:
    """Rows of ``docs`` whose (doc_id, text) is not among ``gone`` ``(doc_id, tag)``; null ids and null texts stay.

    With ``by_text`` false every text of a listed id goes; the caller knows that ids have one text each.
    """
    key, mark = fresh(docs, "gone_id"), fresh(docs, "gone_tag")
    ids = gone.select(F.col("doc_id").alias(key), *([F.col("tag").alias(mark)] if by_text else [])).distinct()
    same = F.col("doc_id").try_cast("bigint") == F.col(key)
    return docs.join(ids, same & (tag() == F.col(mark)) & F.col("text").isNotNull() if by_text else same, "left_anti")


def repeated_ids(docs: DataFrame) -> tuple[bool, bool]:
    """(whether some (doc_id, text) is in several rows, whether some id has several texts), null ids and texts left out."""
    tagged = keyed(docs, "doc_id", "text").filter("text is not null").groupBy("doc_id").agg(F.count("*").alias("n"), (F.min(tag()) != F.max(tag())).alias("several"))
    got = tagged.filter("n > 1").agg(F.count("*"), F.bool_or("several")).first()
    return got[0] > 0, bool(got[1])


def one_row_per_text(docs: DataFrame) -> DataFrame:
    """Rows of one (doc_id, text) collapse to one, the smallest as JSON; null ids and null texts are left alone.

    Only ids and tags move to find repeats; full rows move for repeated ones alone.
    """
    name = fresh(docs, "tag")
    counted = keyed(docs, "doc_id", "text").filter("text is not null").groupBy("doc_id", tag().alias("tag")).count().filter("count > 1").select("doc_id", "tag")
    again = cut(counted)
    if again.isEmpty():
        return docs
    single = without(docs, again, True)
    row = fresh(docs, "row")
    marked = docs.filter(F.col("text").isNotNull()).withColumn(name, tag())
    key = fresh(marked, "again_id")
    other = again.select(F.col("doc_id").alias(key), F.col("tag").alias(f"{key}_tag"))
    hit = marked.join(other, (F.col("doc_id").try_cast("bigint") == F.col(key)) & (F.col(name) == F.col(f"{key}_tag")), "left_semi")
    # a least row is found with map-side combine, so a row repeated any number of times is no hot group
    order = F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), {"ignoreNullFields": "false"})
    least = hit.groupBy("doc_id", name).agg(F.min_by(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]), order).alias(row))
    return single.unionByName(least.select(*[F.col(f"{row}.c{i}").alias(c) for i, c in enumerate(docs.columns)]))


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected edge list: rows ``(node, component)``, component = least node.

    Alternating large-star and small-star steps; every step is a shuffle on the
    node and rounds grow with the logarithm of the longest path.  Each round is cut in
    the shared checkpoint folder, so a lost executor replays one round at most.
    Nodes without an edge do not appear.  Self loops and null ends are dropped.
    """

    def large(e: DataFrame) -> DataFrame:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # a hub's neighbours are reduced before they move, and the join may split them, so no task holds a hub
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        up = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        return up.filter("u <> v").distinct()

    def small(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = F.min("v").over(Window.partitionBy("u"))
        m = down.withColumn("m", low)
        linked = m.select(F.col("v").alias("u"), F.col("m").alias("v")).union(m.select("u", F.col("m").alias("v")))
        return linked.filter("u <> v").distinct()

    now = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct())
    seen = None
    for _ in range(max_rounds):
        now = cut(small(large(now)))
        mark = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if tuple(mark) == seen:
            break
        seen = tuple(mark)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)

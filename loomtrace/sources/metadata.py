"""Readers of table metadata: CSV and JSON column lists, merges of several sources, target DDL.

All give one shape, ``(relation, ordinal, column, type, comment, origin)``, with relation and column names in lower case and
relations under their whole names.  Files that can't be read are left out and told by ``problems``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomtrace.plans.catalyst import parse

ALIASES = {
    "relation": ["table_name", "table", "tablename", "full_table_name"],
    "column": ["column_name", "column", "col_name", "field", "name"],
    "type": ["data_type", "column_type", "type"],
    "comment": ["column_comment", "comment", "description"],
}
SHAPE = "relation string, ordinal int, column string, type string, comment string, origin string"


#: Column names by table.
Schema = dict[str, list[str]]


class MetadataFileError(ValueError):
    """A metadata file that can't be read as it stands."""


def relation_key(c: Column) -> Column:
    """Lookup key of a table: last two parts of its name, unquoted, lower case."""
    return F.lower(F.array_join(F.slice(F.split(F.regexp_replace(c, "`", ""), r"\."), F.greatest(F.lit(-2), -F.size(F.split(c, r"\."))), F.lit(2)), "."))


def whole_name(c: Column) -> Column:
    """A table's whole name, unquoted, lower case."""
    return F.lower(F.regexp_replace(c, "`", ""))


def _shaped(df: DataFrame, origin: str) -> DataFrame:
    """Lower-cased names, repeated columns dropped after their first, ordinals from 0."""
    base = df.select(whole_name(F.col("relation")).alias("relation"), F.lower(F.trim("column")).alias("column"), "type", "comment", "at").filter("relation <> '' and column <> ''")
    first = F.row_number().over(Window.partitionBy("relation", "column").orderBy("at"))
    once = base.withColumn("_n", first).filter("_n = 1")
    place = F.row_number().over(Window.partitionBy("relation").orderBy("at")) - 1
    return once.select("relation", place.alias("ordinal"), "column", "type", "comment", F.lit(origin).alias("origin"))


def problems(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``(file, problem, n)`` of metadata files: lines with NUL bytes, empty files, JSON that is none, and JSON without columns in a known shape."""
    rows = []
    for path in paths:
        raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select("value", F.col("_metadata.file_path").alias("file"))
        text = F.trim("value")
        nul = F.length("value") - F.length(F.replace("value", F.lit("\x00"), F.lit("")))
        is_json = F.lower("file").endswith(".json")
        parsed = F.coalesce(F.try_parse_json("value").isNotNull(), F.lit(False))
        kind = F.when(text == "", "empty_file").when(nul > 0, "nul_bytes").when(is_json & ~parsed, "invalid_json").when(is_json & (_kind() == "bad"), "no_columns")
        rows.append(raw.select("file", kind.alias("problem"), F.when(nul > 0, nul).otherwise(1).alias("n")).filter("problem is not null"))
    every = rows[0]
    for r in rows[1:]:
        every = every.union(r)
    return every


def read_csv(spark: SparkSession, path: str, nul: str = "error", most: int = 1 << 24) -> DataFrame:
    """Column rows with a header, tab- or comma-separated; header names may be any of ``ALIASES``.

    A NUL byte is an error, or is removed with ``nul='remove'``; ``problems`` counts them.  A line longer than ``most``
    characters is an error, since a quote that never closes swallows the rest of a file.
    """
    lines = spark.read.text(path).withColumn("at", F.monotonically_increasing_id())
    if not lines.filter(F.length("value") > most).isEmpty():
        raise MetadataFileError(f"{path} has a line of more than {most} characters")
    if nul == "error" and not lines.filter(F.col("value").contains("\x00")).isEmpty():
        raise MetadataFileError(f"{path} holds NUL bytes")
    lines = lines.withColumn("value", F.regexp_replace("value", "\x00", ""))
    header = lines.orderBy("at").first()
    if header is None:
        raise MetadataFileError(f"{path} is empty")
    sep = "\t" if header.value.count("\t") > header.value.count(",") else ","
    names = [n.strip().strip('"﻿').lower() for n in header.value.split(sep)]
    chosen = {k: next((n for n in v if n in names), None) for k, v in ALIASES.items()}
    if not chosen["relation"] or not chosen["column"]:
        raise MetadataFileError(f"{path} has no table or column header")
    schema = ", ".join(f"`{n}_{i}` string" for i, n in enumerate(names))
    row = F.from_csv("value", schema, {"sep": sep})
    pick = lambda k: (row[f"{chosen[k]}_{names.index(chosen[k])}"] if chosen[k] else F.lit(None).cast("string")).alias(k)
    return _shaped(lines.filter(F.col("at") > header.at).select(pick("relation"), pick("column"), pick("type"), pick("comment"), "at"), path)


_DETAIL = "struct<name:string,type:string,comment:string>"


_RICH = f"struct<table_name:string,schema:array<{_DETAIL}>>"


def _kind() -> Column:
    """Which shape of column list a JSON text has."""
    listed = F.from_json("value", f"struct<tables:array<{_RICH}>>")["tables"]
    return F.when(F.substring(F.trim("value"), 1, 1) == "[", "rows").when(F.from_json("value", _RICH)["table_name"].isNotNull(), "rich").when(F.size(listed) > 0, "tables").when(F.from_json("value", "map<string,string>").isNotNull(), "keyed").otherwise("bad")


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Column lists from a JSON file or folder, in any of the shapes

    ``{"db.t": ["c"]}``, ``{"db.t": [{"name": ..}]}``, ``{"db.t": {"column_details": [..]}}``, ``{"tables": [..]}``,
    ``{"table_name": .., "schema": [..]}`` and a list of rows with table and column names.
    """
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json").select("value", F.col("_metadata.file_path").alias("file"))
    one = F.from_json("value", _RICH)
    listed = F.from_json("value", f"struct<tables:array<{_RICH}>>")["tables"]
    rows = F.from_json("value", "array<struct<table_name:string,table:string,column_name:string,column:string,data_type:string,type:string,comment:string>>")
    keyed = F.from_json("value", "map<string,string>")
    marked = raw.withColumn("kind", _kind())
    if marked.filter("kind <> 'bad'").isEmpty():
        raise MetadataFileError(f"no readable metadata below {path}")
    wide = marked.filter("kind in ('rich', 'tables')").select("file", F.explode(F.when(F.col("kind") == "rich", F.array(one)).otherwise(listed)).alias("t")).select("file", F.col("t.table_name").alias("relation"), F.posexplode("t.schema").alias("n", "c"))
    wide = wide.select("file", "relation", "n", F.col("c.name").alias("column"), F.col("c.type").alias("type"), F.col("c.comment").alias("comment"))
    flat = marked.filter("kind = 'rows'").select("file", F.posexplode(rows).alias("n", "c")).select("file", F.coalesce("c.table_name", "c.table").alias("relation"), "n", F.coalesce("c.column_name", "c.column").alias("column"), F.coalesce("c.data_type", "c.type").alias("type"), "c.comment")
    pairs = marked.filter("kind = 'keyed'").select("file", F.explode(keyed).alias("relation", "body"))
    names, details = F.from_json("body", "array<string>"), F.from_json("body", f"array<{_DETAIL}>")
    nested = F.from_json("body", f"struct<column_details:array<{_DETAIL}>>")["column_details"]
    plain = F.transform(names, lambda x: F.struct(x.alias("name"), F.lit(None).cast("string").alias("type"), F.lit(None).cast("string").alias("comment")))
    # objects also read as strings, so the list of names counts only where its first entry is none
    is_object = F.trim("body").rlike(r"^\[\s*\{")
    entries = F.when(F.trim("body").startswith("{"), nested).when(is_object, details).otherwise(plain)
    map_rows = pairs.select("file", "relation", F.posexplode(entries).alias("n", "c")).select("file", "relation", "n", F.col("c.name").alias("column"), F.col("c.type").alias("type"), F.col("c.comment").alias("comment"))
    every = wide.unionByName(flat).unionByName(map_rows)
    return _shaped(every.withColumn("at", F.struct("file", "n")), path)


def merge(sources: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """``(columns, conflicts)``: for each relation the first source that has it counts.

    Later sources fill in relations that it lacks, and types and comments that its columns lack; lists of columns that differ are
    conflicts, never merged in.
    """
    if not sources:
        raise ValueError("no metadata sources")
    every = sources[0].withColumn("rank", F.lit(0))
    for k, s in enumerate(sources[1:], 1):
        every = every.unionByName(s.withColumn("rank", F.lit(k)))
    best = F.min("rank").over(Window.partitionBy("relation"))
    chosen = every.withColumn("_best", best).filter("rank = _best").drop("rank", "_best")
    known = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct("rank", F.col(c).alias("v"))))["v"].alias(f"_{c}")
    told = every.groupBy("relation", "column").agg(known("type"), known("comment"))
    chosen = chosen.join(told, ["relation", "column"]).select("relation", "ordinal", "column", F.coalesce("type", "_type").alias("type"), F.coalesce("comment", "_comment").alias("comment"), "origin")
    lists = every.groupBy("relation", "rank", "origin").agg(F.sort_array(F.collect_list(F.struct("ordinal", "column"))).alias("c")).select("relation", "rank", "origin", F.transform("c", lambda x: x["column"]).alias("columns"))
    base = lists.withColumn("_best", best).filter("rank = _best").select("relation", F.col("columns").alias("kept"))
    conflicts = lists.join(base, "relation").filter(F.col("columns") != F.col("kept")).select("relation", "origin", "kept", F.col("columns").alias("ignored"))
    return chosen, conflicts


def from_catalog(spark: SparkSession, tables: list[str]) -> DataFrame:
    """Columns of tables or views that the session's catalog knows; unknown names are left out."""
    rows = []
    for t in tables:
        if spark.catalog.tableExists(t):
            rows += [(t.lower(), i, f.name.lower(), f.dataType.simpleString(), (f.metadata or {}).get("comment"), "catalog") for i, f in enumerate(spark.table(t).schema.fields)]
    return spark.createDataFrame(rows, SHAPE)


def latest(targets: DataFrame, by: tuple[str, ...] = ("query_time", "ddl_update_time")) -> DataFrame:
    """The newest export of each relation; an equal or missing time among several is an error, since nothing tells which counts."""
    time = F.coalesce(*[F.to_timestamp(c) for c in by])
    marked = targets.withColumn("_time", time).withColumn("_n", F.count("*").over(Window.partitionBy("relation")))
    marked = marked.withColumn("_rank", F.rank().over(Window.partitionBy("relation").orderBy(F.col("_time").desc_nulls_last())))
    unclear = marked.filter("_n > 1").groupBy("relation").agg(F.count(F.when(F.col("_rank") == 1, 1)).alias("first"), F.count(F.when(F.col("_time").isNull(), 1)).alias("missing")).filter("first > 1 or missing > 0").take(5)
    if unclear:
        raise MetadataFileError("no newest version of " + ", ".join(sorted(r.relation for r in unclear)))
    return marked.filter("_rank = 1").drop("_time", "_n", "_rank")


def ddl_columns(spark: SparkSession, ddl: str) -> list[tuple[str, str, str | None, bool]]:
    """``(name, type, comment, is_partition)`` of a ``CREATE TABLE``, by Catalyst; keyword names need no quoting."""
    tree = parse(spark, ddl).tree
    if tree.kind != "CreateTable":
        raise MetadataFileError(f"not a table definition: {tree.kind}")
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(ddl)
    partitions = [plan.partitioning().apply(i).describe().strip("`").lower() for i in range(plan.partitioning().size())]
    out = []
    for c in tree.nodes("columns"):
        name = str(c.fields["name"]).lower()
        comment = c.fields.get("comment")
        out.append((name, str(c.fields["dataType"]), comment if isinstance(comment, str) else None, name in partitions))
    return out


def target_columns(spark: SparkSession, ddls: dict[str, str]) -> DataFrame:
    """``(relation, ordinal, column, type, comment, origin, is_partition)`` from the DDL of each relation; the DDL is the authority."""
    rows = [(name.lower(), i, *c[:3], "ddl", c[3]) for name, ddl in ddls.items() for i, c in enumerate(ddl_columns(spark, ddl))]
    return spark.createDataFrame(rows, SHAPE + ", is_partition boolean")


_TARGET = "table_name string, full_table_name string, schema array<struct<columnName:string,columnType:string,columnComment:string,columnIndex:int,isPartition:int>>, ddl string, query_time string, ddl_update_time string, data_source string, _corrupt_record string"


def read_targets(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(columns, problems)`` of target exports, one JSON object a file, in a file or folder.

    The newest export of each table counts (``latest``).  Its DDL is the authority on columns; where there is none, or none that
    Catalyst reads, its list of columns serves.  A broken file, and a list that differs from its DDL, are problems;
    a folder without a single readable export is an error.
    """
    raw = spark.read.schema(_TARGET).json(path, multiLine=True, recursiveFileLookup=True, pathGlobFilter="*.json", columnNameOfCorruptRecord="_corrupt_record").select("*", F.col("_metadata.file_path").alias("file"))
    named = raw.withColumn("relation", whole_name(F.coalesce("full_table_name", "table_name")))
    bad = F.when(F.col("_corrupt_record").isNotNull(), "invalid_json").when(F.col("relation").isNull(), "no_table_name")
    good = named.filter(bad.isNull())
    told = [(r.file, r.problem) for r in named.select("file", bad.alias("problem")).filter("problem is not null").collect()]
    if good.isEmpty():
        raise MetadataFileError(f"no readable target export below {path}")
    rows: list[tuple] = []
    for r in latest(good).toLocalIterator():  # the parser lives with the session; exports arrive one at a time
        listed = sorted((c for c in r.schema or [] if c.columnName), key=lambda c: c.columnIndex or 0)
        own = [(c.columnName.lower(), c.columnType, c.columnComment, bool(c.isPartition)) for c in listed]
        try:
            by_ddl = ddl_columns(spark, r.ddl) if r.ddl else []
        except (MetadataFileError, ValueError) as e:
            by_ddl = []
            told.append((r.file, f"ddl_not_readable: {str(e)[:100]}"))
        if by_ddl and own and [c[0] for c in by_ddl] != [c[0] for c in own]:
            told.append((r.file, "columns_differ_from_ddl"))
        rows += [(r.relation, i, *c[:3], r.file, c[3]) for i, c in enumerate(by_ddl or own)]
    return spark.createDataFrame(rows, SHAPE + ", is_partition boolean"), spark.createDataFrame(told, "file string, problem string")


def as_schema(columns: DataFrame) -> Schema:
    """Metadata as the reader wants it.  The number of tables is that of a warehouse's catalog, which the driver holds anyway to parse against."""
    rows = columns.groupBy("relation").agg(F.sort_array(F.collect_list(F.struct("ordinal", "column"))).alias("c")).collect()
    return {r.relation: [x.column for x in r.c] for r in rows}


def related(columns: DataFrame, usage: DataFrame) -> DataFrame:
    """Metadata of the fields that are used: ``usage`` has ``source`` and ``field``."""
    used = usage.select(relation_key(F.col("source")).alias("relation"), F.lower("field").alias("column")).distinct()
    return columns.withColumn("_key", relation_key(F.col("relation"))).join(used.withColumnRenamed("relation", "_key"), ["_key", "column"], "left_semi").drop("_key")

"""Readers of SQL files and scheduler task exports."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ROW = "struct<task_name:string,task_id:string>"
TASK = f"meta struct<sql:string,task_name:string,task_id:string,upstream_tasks:array<{_ROW}>,downstream_tasks:array<{_ROW}>>, sql string, task_name string, query_time string, data_source string, _corrupt_record string"


class EmptySource(ValueError):
    """A folder without a readable task."""


def _stem(path: str = "path") -> F.Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def sql_files(spark: SparkSession, path: str) -> DataFrame:
    """``(task, path, sql)``: whole ``.sql`` files; a task is named after its file."""
    text = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.sql").select("value", F.col("_metadata.file_path").alias("path"))
    return text.select(_stem().alias("task"), "path", F.col("value").alias("sql"))


def tasks(spark: SparkSession, path: str) -> DataFrame:
    """``(task, path, sql, upstream, downstream, error)`` of task exports, wrapped (``meta.sql``) or flat (``sql``).

    ``error`` names what is wrong with a file (``invalid_json``, ``no_sql``); its other rows are unharmed.
    """
    raw = spark.read.schema(TASK).json(path, multiLine=True, recursiveFileLookup=True, pathGlobFilter="*.json", columnNameOfCorruptRecord="_corrupt_record").select("*", F.col("_metadata.file_path").alias("path"))
    sql = F.coalesce("meta.sql", "sql")
    error = F.when(F.col("_corrupt_record").isNotNull(), "invalid_json").when(sql.isNull() | (F.trim(sql) == ""), "no_sql")
    name = F.coalesce("meta.task_name", "meta.task_id", "task_name", _stem())
    return raw.select(name.alias("task"), "path", sql.alias("sql"), F.col("meta.upstream_tasks").alias("upstream"), F.col("meta.downstream_tasks").alias("downstream"), error.alias("error"))


def readable(spark: SparkSession, path: str) -> DataFrame:
    """Tasks with SQL; a folder that has none is an error."""
    good = tasks(spark, path).filter("error is null")
    if good.isEmpty():
        raise EmptySource(f"no task with SQL below {path}")
    return good


def task_dependencies(read: DataFrame) -> DataFrame:
    """``(task, dependency, direction, other_task, other_id)``: declared neighbours, numbered as ``taskdep:<direction>:NNN``."""
    def side(direction: str) -> DataFrame:
        one = read.select("task", F.posexplode(direction).alias("at", "row"))
        return one.select("task", F.format_string(f"taskdep:{direction}:%03d", F.col("at") + 1).alias("dependency"), F.lit(direction).alias("direction"), F.col("row.task_name").alias("other_task"), F.col("row.task_id").alias("other_id"))

    return side("upstream").union(side("downstream"))


def mirrored(read: DataFrame, root: str) -> DataFrame:
    """Tasks named by their folder below ``root`` as well, so that equal file names in two folders are two tasks."""
    below = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/+", "/"), F.lit("^/*" + re.escape(root.rstrip("/").lstrip("/")) + "/?"), F.lit(""))
    folder = F.regexp_replace(below, r"[^/]*$", "")
    return read.withColumn("task", F.concat(folder, "task"))


def collisions(read: DataFrame) -> DataFrame:
    """Output names that more than one file would write: ``(task, files)``."""
    return read.groupBy("task").agg(F.sort_array(F.collect_set("path")).alias("files")).filter(F.size("files") > 1)

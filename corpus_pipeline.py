"""The corpus pipeline: quality, exact duplicates, near duplicates, benchmark leaks, packing.

``STAGES`` is a list of ``(name, function)``; each function takes ``(spark, docs, sf_dir)`` and
returns a DataFrame.  All but the last return the columns of ``docs``, whatever their names, and every row that they keep as it
was.  The quality stage and packing are maps over texts and decontamination is two; the two stages
between them end in an anti-join on ids, which moves each text once where the ids are too many to broadcast.

Common to all stages: an empty table gives an empty result; rows with a null doc_id, or one that is no whole number, can't be named and
so are never taken for copies or leaks; a text is taken as a whole, however long it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomtrace.llm import decontaminate, exact_dedup, line_crf, minhash_dedup, packing
from loomtrace.llm.common import remove, shared_folder, table
from loomtrace.llm.queries import RANKS


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line model rejects go.

    Null, empty and blank texts have no lines and go; a quality of exactly the threshold stays; repeated rows are judged alike;
    rows with a null doc_id are judged by their text like any other.
    """
    return line_crf.keep_good(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text stays, under its least id.

    Decided by (doc_id, text): an id's other texts stay.  Repeated rows of an id and text collapse to the smallest row. Null texts stay; empty
    texts equal each other.
    """
    return exact_dedup.drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the least (id, text).

    Groups are what links connect.  Null texts and texts without a word are in no group and stay; repeated rows of an id and text
    collapse.
    """
    return minhash_dedup.drop_near_duplicates(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Of an id with several texts only those with an item go.  Repeated rows and null texts stay as they are.
    """
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of the documents that are left.

    Null and empty texts and null ids take no place; repeated rows are items of their own; ties of free space are served oldest first.
    """
    return packing.pack(docs, ranks_path=RANKS)


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("decontamination", leaks), ("packing", pack)]

#: A conditional random field is not expressible in SQL; tests/llm/test_pipeline.py holds every stage and run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between stages the rows are a Parquet table in the shared checkpoint folder, of which the last two are kept at most."""
    folder = shared_folder(spark, "pipeline")
    docs, before = table(spark, sf_dir, "documents"), ""
    for k, (name, stage) in enumerate(STAGES[:-1]):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)

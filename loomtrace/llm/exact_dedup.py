"""Exact duplicates by content-defined chunk recipes.

A text is cut where a rolling hash of its last 32 bytes matches a mask, so equal texts
always cut alike.  Chunks are reduced to their distinct contents once, with
map-side combine, and every chunk gets an identifier that is proved by its bytes: two
different contents never share one, even when their 64-bit hashes collide.  A
document is then only its ordered identifier list (its recipe), and equal recipes
mean equal bytes.  Long texts move at most once, as chunks; grouping moves recipes.

Defined results
  * null text: never a duplicate; null doc_id, or one that is no whole number: ignored.
  * empty texts equal each other (empty recipe).
  * repeated rows of one doc_id: no pair of an id with itself.
  * an id with several texts: each text has its own group, so such an id may be a copy by one text and not by
    another.  ``drop_exact_duplicates`` decides by (doc_id, text), never by id alone.
  * ties: the least doc_id of a group is kept.
  * empty table: empty result.  Extra columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .common import cut, keyed, one_row_per_text, repeated_ids, tag, without

_GEAR = np.random.default_rng(77).integers(0, 2**32, 256, dtype=np.uint32)


def cut_points(offs: np.ndarray, data: np.ndarray, average: int, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Chunk edges of a block: (edges over the whole buffer, number of chunks of each text)."""
    h = _GEAR[data]
    for shift in (1, 2, 4, 8, 16):
        g = h.copy()
        g[shift:] += h[:-shift] << np.uint32(shift)
        h = g
    marks = np.flatnonzero((h >> np.uint32(32 - int(average).bit_length() + 1)) == 0) + 1
    at = np.searchsorted(marks, offs)
    edges, counts = [0], np.zeros(len(offs) - 1, np.int64)
    for d in range(len(offs) - 1):
        a, z = int(offs[d]), int(offs[d + 1])
        before = len(edges)
        if z - a <= least:
            if z > a:
                edges.append(z)
        else:
            last = a
            for m in [*marks[at[d] : at[d + 1]].tolist(), z]:
                while m - last > most:
                    last += most
                    edges.append(last)
                if m - last >= least or (m == z and m > last):
                    last = m
                    edges.append(m)
        counts[d] = len(edges) - before
    return np.array(edges, np.int64), counts


def _chunk_job(kind: str, average: int, least: int, most: int, bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    mask = np.uint64((1 << bits) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, offs, data in K.blocks(batch.column(2)):
                edges, counts = cut_points(offs, data, average, least, most)
                h = (K.span_hashes(data, edges[:-1], edges[1:]) & mask).view(np.int64)
                body = pa.Array.from_buffers(pa.binary(), len(h), [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
                ids, tags = batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i)
                if kind == "chunks":
                    yield pa.RecordBatch.from_arrays([pa.array(h), body], ["hash", "body"])
                    continue
                at = np.concatenate([[0], np.cumsum(counts)])
                if kind == "recipes":
                    recipe = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(h))
                    yield pa.RecordBatch.from_arrays([ids, tags, recipe], ["doc_id", "tag", "hashes"])
                else:
                    whole = pa.array([xxhash.xxh3_128_digest(data[offs[d] : offs[d + 1]]) for d in range(j - i)], pa.binary())
                    row = np.repeat(np.arange(j - i), counts)
                    pos, take = np.arange(len(h)) - at[row], pa.array(row)
                    yield pa.RecordBatch.from_arrays([ids.take(take), tags.take(take), whole.take(take), pa.array(pos.astype(np.int32)), pa.array(h), body], ["doc_id", "tag", "whole", "pos", "hash", "body"])

    return run


def recipes(docs: DataFrame, average: int = 1024, least: int = 256, most: int = 8192, hash_bits: int = 64) -> DataFrame:
    """``(doc_id, tag, ids)``: each text's ordered list of verified chunk identifiers; ``tag`` tells texts of one id apart.

    An identifier is ``(hash, n)``; ``n`` tells apart different contents of one hash,
    in byte order, and is 0 where the hash has a single content.
    """
    if not 32 <= least <= average <= most or average & (average - 1):
        raise ValueError("chunk sizes need 32 <= least <= average <= most and an average that is a power of two")
    texts = keyed(docs, "doc_id", tag().alias("tag"), "text").filter(F.col("text").isNotNull())

    def job(kind: str, schema: str) -> DataFrame:
        return texts.mapInArrow(_chunk_job(kind, average, least, most, hash_bits), schema)

    listed = job("recipes", "doc_id bigint, tag bigint, hashes array<bigint>")
    distinct = job("chunks", "hash bigint, body binary").distinct()
    shared = cut(distinct.groupBy("hash").count().filter("count > 1").select("hash"))
    if shared.isEmpty():
        return listed.select("doc_id", "tag", F.transform("hashes", lambda h: F.struct(h.alias("hash"), F.lit(0).alias("n"))).alias("ids"))
    told = distinct.join(shared, "hash", "left_semi").withColumn("n", F.row_number().over(Window.partitionBy("hash").orderBy("body")))
    spots = job("spots", "doc_id bigint, tag bigint, whole binary, pos int, hash bigint, body binary").join(shared, "hash", "left_semi")
    named = spots.join(told, ["hash", "body"]).select("doc_id", "tag", "whole", "pos", "n").distinct()
    maps = named.groupBy("doc_id", "tag", "whole").agg(F.map_from_entries(F.collect_list(F.struct("pos", "n"))).alias("ns")).drop("whole")
    return listed.join(maps, ["doc_id", "tag"], "left").select(
        "doc_id", "tag",
        F.transform("hashes", lambda h, i: F.struct(h.alias("hash"), F.coalesce(F.element_at("ns", i), F.lit(0)).alias("n"))).alias("ids"),
    )


def _copies(docs: DataFrame, **options: int) -> DataFrame:
    """``(doc_id, tag, keep_id)`` of every text that a lesser id has as well.

    The least id of each recipe is found with map-side combine; only recipes that occur again are joined back.
    """
    listed = recipes(docs, **options)
    again = listed.groupBy("ids").agg(F.min("doc_id").alias("keep_id"), F.max("doc_id").alias("last")).filter("keep_id < last").select("ids", "keep_id")
    return listed.join(again, "ids").filter("doc_id <> keep_id").select("doc_id", "tag", "keep_id")


def exact_duplicates(docs: DataFrame, average: int = 1024, least: int = 256, most: int = 8192, hash_bits: int = 64) -> DataFrame:
    """Pairs ``(doc_id, keep_id)``: each document whose bytes equal those of ``keep_id``, the least id with that text."""
    return _copies(docs, average=average, least=least, most=most, hash_bits=hash_bits).select("doc_id", "keep_id").distinct()


def drop_exact_duplicates(docs: DataFrame, **options: int) -> DataFrame:
    """``docs`` with one row left of each text, under its least id; null texts and null ids stay.

    A text is dropped by (doc_id, text), so an id's other texts stay; repeated rows of an id and text collapse
    to their smallest row.  Columns are passed on whatever their names.
    """
    repeats, several = repeated_ids(docs)
    left = without(docs, _copies(docs, **options), several)
    return one_row_per_text(left) if repeats else left

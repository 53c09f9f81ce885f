"""Near duplicates: all pairs of MinHash signatures within a Hamming distance.

A document's set of word shingles gives ``size`` minima; each is kept as a ``bits``-wide
symbol, and the distance of two signatures is the number of positions where their
symbols differ (about ``size * (1 - Jaccard)``).

Multi-index join.  The positions are split into ``chunks`` parts; part ``i`` is allowed
``e_i`` errors with ``sum(e_i + 1) = distance + 1``.  If every part of a pair had more
errors than allowed, the pair would have more than ``distance`` errors in all, so two
signatures within ``distance`` always agree on some part up to its allowance.  Each
allowance is enumerated on both sides by leaving out every choice of ``e_i`` positions,
and equal keys make candidates.  Candidates are verified on the full signatures, so the
result is every pair within the distance and no other; there is no cap on bucket sizes.

Texts with one signature are collapsed to their least id first, so exact copies cost linear work.
``near_duplicates`` counts every link between different signatures.  ``drop_near_duplicates``
needs only what is connected: in each bucket every signature is tried against the bucket's least one, and pairs
of a bucket are tried only where that left them in different groups, so a large group of near
copies costs linear work there.  Both find the same groups.

Defined results
  * words are runs of letters and digits (any byte outside ASCII counts as a letter), lower-cased.
  * null text, empty text and text without a word: no signature, in no group; they are never dropped.
  * a text shorter than a shingle is one shingle of all its words.
  * null doc_id, or one that is no whole number: ignored, never dropped.
  * repeated rows of an id with one text: one text, which is no copy of itself.
  * an id whose rows have different texts: each text is compared on its own; ``near_duplicates`` then has a row for
    each of its signatures, ``drop_near_duplicates`` decides by (doc_id, text).
  * ties: the least id, then the least text hash, represents a group.
  * empty table: empty result.  Extra columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import components, cut, keyed, one_row_per_text, repeated_ids, tag, without

SYMBOL_BITS = 16


def minima(offs: np.ndarray, data: np.ndarray, size: int, shingle: int, mult: np.ndarray, add: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows that have a word, their symbols as ``uint16``) of a block."""
    starts, ends, first = K.words(offs, data)
    h = K.span_hashes(data, starts, ends)
    grams, _, edge = K.gram_hashes(h, first, shingle)
    n_words = np.diff(first)
    short = np.flatnonzero((n_words > 0) & (n_words < shingle))
    if len(short):  # one shingle of everything they have
        whole = np.array([K.mix(np.bitwise_xor.reduce(h[first[d] : first[d + 1]] * np.uint64(3) + np.arange(n_words[d], dtype=np.uint64))[None])[0] for d in short], np.uint64)
        grams = np.insert(grams, edge[short], whole)
        edge = edge + np.concatenate([[0], np.cumsum((n_words > 0) & (n_words < shingle))])
    rows = np.flatnonzero(np.diff(edge))
    if not len(rows):
        return rows, np.zeros((0, size), np.uint16)
    at, out = edge[rows], np.empty((len(rows), size), np.uint64)
    v = np.empty_like(grams)
    for k in range(size):
        np.multiply(grams, mult[k], out=v)
        np.add(v, add[k], out=v)
        out[:, k] = np.minimum.reduceat(v, at)
    return rows, (K.mix(out) & np.uint64(0xFFFF)).astype(np.uint16)


def _signer(size: int, shingle: int, bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    rng = np.random.default_rng(991)
    mult, add = rng.integers(1, 2**63, size, dtype=np.uint64) | np.uint64(1), rng.integers(0, 2**63, size, dtype=np.uint64)
    mask, names = np.uint16((1 << bits) - 1), ["doc_id", "tag", "g", *[f"s{i}" for i in range(size // 4)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, offs, data in K.blocks(K.lower(batch.column(2))):
                rows, sig = minima(offs, data, size, shingle, mult, add)
                packed = np.ascontiguousarray(sig & mask).view(np.int64)
                low = np.zeros((len(rows), 64), np.uint8)
                low[:, : min(size, 64)] = sig[:, :64] & 1
                sketch = np.ascontiguousarray(np.packbits(low, axis=1)).view(np.int64)[:, 0]
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(i, j - i).take(pa.array(rows)) for c in (0, 1)], pa.array(sketch), *[pa.array(np.ascontiguousarray(packed[:, c])) for c in range(size // 4)]], names)

    return run


def layout(size: int, distance: int, chunks: int) -> list[tuple[list[int], int]]:
    """Positions and allowed errors of each part; the sum of (allowance + 1) is ``distance + 1``."""
    if not 0 <= distance < size or not 1 <= chunks <= distance + 1:
        raise ValueError("need 0 <= distance < size and 1 <= chunks <= distance + 1")
    low, extra = divmod(distance + 1 - chunks, chunks)
    errors = [low + (i < extra) for i in range(chunks)]
    keyed_symbols, at, parts = size - sum(errors), 0, []
    for i, e in enumerate(errors):
        n = e + keyed_symbols // chunks + (chunks - 1 - i < keyed_symbols % chunks)
        parts.append((list(range(at, at + n)), e))
        at += n
    return parts


def _keyer(size: int, distance: int, chunks: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    masks = [(c, kept) for c, (part, e) in enumerate(layout(size, distance, chunks)) for kept in combinations(part, len(part) - e)]
    rng = np.random.default_rng(515)
    weight = rng.integers(1, 2**63, size, dtype=np.uint64) | np.uint64(1)
    code = rng.integers(1, 2**63, len(masks), dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            packed = np.stack([batch.column(2 + c).to_numpy(zero_copy_only=False) for c in range(size // 4)], axis=1)
            sym = np.ascontiguousarray(packed).view(np.uint16).astype(np.uint64)
            spread = K.mix((sym + np.uint64(1)) * weight)
            for m, (_, kept) in enumerate(masks):
                key = K.mix(np.add.reduce(spread[:, list(kept)], axis=1) ^ code[m]) if kept else np.full(len(sym), code[m])
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column(0), batch.column(1)], ["key", "doc_id", "g"])

    return run


def signatures(docs: DataFrame, size: int = 64, shingle: int = 2, bits: int = SYMBOL_BITS) -> DataFrame:
    """``(doc_id, tag, g, s0, s1, ...)``: four 16-bit symbols in each long, ``bits`` of each in use; ``g`` holds the lowest bit of each of the first 64, ``tag`` tells texts of one id apart."""
    if size % 4 or not 1 <= bits <= 16:
        raise ValueError("size must be a multiple of 4 and bits between 1 and 16")
    schema = "doc_id bigint, tag bigint, g bigint, " + ", ".join(f"s{i} bigint" for i in range(size // 4))
    return keyed(docs, "doc_id", tag().alias("tag"), "text").filter(F.col("text").isNotNull()).mapInArrow(_signer(size, shingle, bits), schema)


def _distance(n_longs: int, a: str, b: str) -> F.Column:
    """Number of differing 16-bit symbols.

    Adding 0x7fff to a symbol's low bits carries into its top bit unless they are all zero; the
    topmost symbol is tested on its own, since its carry would overflow a signed long.
    """
    total = F.lit(0)
    low = F.lit(0x00007FFF7FFF7FFF)
    for i in range(n_longs):
        x = F.col(f"{a}.s{i}").bitwiseXOR(F.col(f"{b}.s{i}"))
        full = (x.bitwiseAND(low) + low).bitwiseOR(x).bitwiseAND(F.lit(0x0000800080008000))
        total = total + F.bit_count(full) + (F.shiftrightunsigned(x, 48) > 0).cast("int")
    return total


class Index:
    """Distinct signatures, each named by the least id and text that has it, and their bucket keys."""

    def __init__(self, docs: DataFrame, several: bool, size: int, distance: int, chunks: int, shingle: int, bits: int) -> None:
        self.size, self.distance = size, distance
        self.longs = [f"s{i}" for i in range(size // 4)]
        one = F.struct("doc_id", "tag") if several else F.col("doc_id")
        #: (node, g, s0, ...) of every text with a signature; a node is its id, or id and tag where ids have several texts
        self.texts = cut(signatures(docs, size, shingle, bits).select(one.alias("node"), "g", *self.longs).distinct())
        # least ids are found with map-side combine, so a signature that a third of all texts share is no hot group
        self.firsts = cut(self.texts.groupBy("g", *self.longs).agg(F.min("node").alias("rep"), F.count("*").alias("n")))
        self.reps = self.firsts.select(F.col("rep").alias("node"), "g", *self.longs)
        node = "struct<doc_id: bigint, tag: bigint>" if several else "bigint"
        self.keys = self.reps.mapInArrow(_keyer(size, distance, chunks), f"key bigint, node {node}, g bigint")

    def members(self) -> DataFrame:
        """``(node, rep)`` of the texts whose signature another text has too, their representative left out."""
        shared = self.firsts.filter("n > 1").drop("n")
        return self.texts.join(shared, ["g", *self.longs]).filter("node <> rep").select("node", "rep")

    def close(self, tried: DataFrame) -> DataFrame:
        """``(a, b, distance)`` of those pairs ``(a, b)`` of representatives that lie within the distance."""
        x, y = self.reps.alias("x"), self.reps.alias("y")
        met = tried.join(x, F.col("a") == F.col("x.node")).join(y, F.col("b") == F.col("y.node"))
        return met.withColumn("distance", _distance(self.size // 4, "x", "y")).filter(F.col("distance") <= self.distance).select("a", "b", "distance")

    def _may(self, a: str, b: str) -> F.Column:
        # low bits differ only where symbols do, so this drops no pair within the distance
        return F.bit_count(F.col(f"{a}.g").bitwiseXOR(F.col(f"{b}.g"))) <= self.distance

    def links(self) -> DataFrame:
        """``(a, b, distance)``, ``a < b``: all pairs of representatives within the distance."""
        a, b = self.keys.alias("a"), self.keys.alias("b")
        tried = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.node") < F.col("b.node")) & self._may("a", "b"))
        return self.close(tried.select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct())

    def groups(self) -> DataFrame:
        """``(node, component)``: representatives that links connect, found without all pairs of a bucket."""
        # a bucket's least node is found with map-side combine; every other member is tried against it
        head = self.keys.groupBy("key").agg(F.min(F.struct("node", "g")).alias("h"), F.count("*").alias("n")).filter("n > 1").select("key", F.col("h.node").alias("node"), F.col("h.g").alias("g"))
        keys = cut(self.keys)
        m, h = keys.alias("m"), head.alias("h")
        star = m.join(h, (F.col("m.key") == F.col("h.key")) & (F.col("m.node") != F.col("h.node")) & self._may("m", "h"))
        edges = cut(self.close(star.select(F.col("h.node").alias("a"), F.col("m.node").alias("b")).distinct()).select("a", "b"))
        found = cut(components(edges))
        # what is left: members of one bucket that are not connected yet; a bucket that is one group has none
        placed = keys.join(found, "node", "left").select("key", "node", "g", F.coalesce("component", "node").alias("component"))
        mixed = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("key")
        rest = cut(placed.join(mixed, "key", "left_semi"))
        a, b = rest.alias("a"), rest.alias("b")
        apart = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.component") < F.col("b.component")) & self._may("a", "b"))
        more = self.close(apart.select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct()).select("a", "b")
        return components(edges.union(more))


def near_duplicates(docs: DataFrame, size: int = 64, distance: int = 20, chunks: int = 20, shingle: int = 2, bits: int = SYMBOL_BITS) -> DataFrame:
    """``(doc_id, class_id, same_id, links)`` of every document that has a copy or a near copy.

    ``class_id`` is the least id that links connect it to, ``same_id`` the least id with its signature, ``links`` the number of
    other signatures within the distance of its own; every link counts, on both of its sides.
    """
    several = repeated_ids(docs)[1]
    index = Index(docs, several, size, distance, chunks, shingle, bits)
    links = cut(index.links())
    ends = links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("links"))
    linked = components(links).join(ends, "node").select(F.col("node").alias("rep"), "component", "links")
    copies = index.firsts.filter("n > 1").select("rep").join(linked, "rep", "full").select("rep", F.coalesce("component", "rep").alias("component"), F.coalesce("links", F.lit(0)).alias("links"))
    every = index.members().union(copies.select(F.col("rep").alias("node"), "rep")).join(copies, "rep")
    name = lambda c: F.col(f"{c}.doc_id") if several else F.col(c)
    return every.select(name("node").alias("doc_id"), name("component").alias("class_id"), name("rep").alias("same_id"), "links")


def drop_near_duplicates(docs: DataFrame, size: int = 64, distance: int = 20, chunks: int = 20, shingle: int = 2, bits: int = SYMBOL_BITS) -> DataFrame:
    """``docs`` with the least (id, text) left of every group that near-duplicate pairs connect; texts without a signature stay.

    Repeated rows of an id and text collapse to their smallest row.  Columns are passed on whatever their names.
    """
    repeats, several = repeated_ids(docs)
    index = Index(docs, several, size, distance, chunks, shingle, bits)
    gone = index.members().select("node").union(index.groups().filter("node <> component").select("node"))
    gone = gone.select("node.doc_id", "node.tag") if several else gone.select(F.col("node").alias("doc_id"))
    left = without(docs, gone, several)
    return one_row_per_text(left) if repeats else left

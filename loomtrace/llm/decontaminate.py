"""Benchmark decontamination: prefix-filtered set join of benchmark items and documents.

Items and documents are sequences of ``n``-word shingles.  An item leaks into a document
when some window of the document, as long as the item, holds at least
``ceil(threshold * |item shingles|)`` of the item's distinct shingles.

 1. Rarity.  A pass over the whole texts counts, for every benchmark shingle, the texts that hold it, all
    documents included.  Only counts move.
 2. Prefix.  An item's shingles are ordered by rarity.  A window with the needed overlap holds one of the
    ``|S| - need + 1`` rarest, so these alone are looked up in the documents.
 3. A second pass joins the prefixes with the documents' shingles.  Length bound: a text with fewer shingle
    positions than the needed overlap is passed over.  Positional bound: a hit opens only the positions less than
    one item length away.
 4. Verification.  Within these bounds the item's other shingles are looked up and compared word by
    word, and a window of the item's size slides over them.

The benchmark is the stated query set.  It is taken in blocks of about ``block`` shingles, and both passes are
made for each block, so what is sent to the executors is bounded at every size of the
benchmark (a single longer item is a block of its own) and no text ever moves.

Defined results
  * words are runs of letters and digits (bytes outside ASCII count as letters), lower-cased.
  * an item with fewer than ``n`` words is compared by its single shingle of all its words; an item
    without a word never leaks.
  * null or empty text, null ids or ids that are no whole numbers: no row.  Repeated rows of one (id, text) count once.
  * an id with several texts is judged by its best window in any of them; ``drop_contaminated`` drops only the
    texts that hold an item.
  * ties of rarity: by the shingle's hash; the order never changes the result.
  * empty tables: empty result.  Extra columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import cut, keyed, repeated_ids, tag, without

Batches = Iterator[pa.RecordBatch]
ITEM = "item_id bigint, n int, size int, hashes array<bigint>, words array<binary>"
FOUND = "doc_id bigint, tag bigint, item_id bigint, overlap int, needed int, n_shingles int"


def _itemise(n: int) -> Callable[[Batches], Batches]:
    """Distinct shingles of every item that has a word: ``n`` words each, or all its words where they are fewer."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for i, j, offs, data in K.blocks(K.lower(batch.column(1))):
                starts, ends, first = K.words(offs, data)
                h, raw = K.span_hashes(data, starts, ends), data.tobytes()
                out: list[list] = [[], [], [], [], []]
                for d, item in enumerate(batch.column(0).slice(i, j - i).to_pylist()):
                    a, z = int(first[d]), int(first[d + 1])
                    k = min(n, z - a)
                    if not k:
                        continue
                    grams, at, _ = K.gram_hashes(h[a:z], np.array([0, z - a]), k)
                    own = dict.fromkeys((b" ".join(raw[s:e] for s, e in zip(starts[a + p : a + p + k], ends[a + p : a + p + k])), g) for p, g in zip(at.tolist(), grams.view(np.int64).tolist()))
                    for col, v in zip(out, (item, k, z - a - k + 1, [g for _, g in own], [w for w, _ in own])):
                        col.append(v)
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["item_id", "n", "size", "hashes", "words"])

    return run


def _seen(batches: Batches, wanted: dict[int, np.ndarray]) -> Iterator[tuple]:
    """Of each block of texts: ids, tags, word spans, bytes, and for each shingle length its hashes, their first words, edges and which are wanted."""
    for batch in batches:
        for i, j, offs, data in K.blocks(K.lower(batch.column(2))):
            starts, ends, first = K.words(offs, data)
            h = K.span_hashes(data, starts, ends)
            for n, sought in wanted.items():
                grams, at, edge = K.gram_hashes(h, first, n)
                spot = np.minimum(np.searchsorted(sought, grams), len(sought) - 1)
                yield batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), starts, ends, data, n, grams, at, edge, spot, np.flatnonzero(sought[spot] == grams)


def _counter(wanted: dict[int, np.ndarray]) -> Callable[[Batches], Batches]:
    """(n, hash, texts): in how many texts of a task each wanted shingle occurs."""

    def run(batches: Batches) -> Batches:
        total = {n: np.zeros(len(s), np.int64) for n, s in wanted.items()}
        for *_, n, _, _, edge, spot, hit in _seen(batches, wanted):
            row = np.searchsorted(edge, hit, "right") - 1
            one = np.unique(row * len(wanted[n]) + spot[hit]) % len(wanted[n])
            total[n] += np.bincount(one, minlength=len(wanted[n]))
        for n, s in wanted.items():
            some = np.flatnonzero(total[n])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), n, np.int32)), pa.array(s[some].view(np.int64)), pa.array(total[n][some])], ["n", "hash", "texts"])

    return run


class Items:
    """One block of items with their shingles in order of rarity."""

    def __init__(self, rows: list, threshold: float, texts: dict[tuple[int, int], int]) -> None:
        self.rows, owners = [], {}
        for r in rows:
            by = sorted(zip(r.hashes, r.words), key=lambda s, n=r.n: (texts.get((n, s[0]), 0), s))
            need = int(np.ceil(threshold * len(by) - 1e-9))
            h = np.array([g for g, _ in by], np.int64).view(np.uint64)
            for g in dict.fromkeys(h[: len(by) - need + 1].tolist()):
                owners.setdefault(r.n, {}).setdefault(g, []).append(len(self.rows))
            self.rows.append((r.item_id, r.n, r.size, need, h, [bytes(w) for _, w in by], len(by) - need + 1))
        #: Of each shingle length: the prefixes' hashes, sorted, and the items that each belongs to.
        self.prefix = {n: np.array(sorted(o), np.uint64) for n, o in owners.items()}
        self.owners = {n: [o[g] for g in self.prefix[n].tolist()] for n, o in owners.items()}

    def match(self, batches: Batches) -> Batches:
        for ids, tags, starts, ends, data, n, grams, at, edge, spot, hit in _seen(batches, self.prefix):
            out: list[tuple] = []
            row = np.searchsorted(edge, hit, "right") - 1
            for d in np.unique(row).tolist():
                mine = row == d
                a, z = int(edge[d]), int(edge[d + 1])
                near: dict[int, list[int]] = {}
                for p, s in zip((hit[mine] - a).tolist(), spot[hit[mine]].tolist()):
                    for item in self.owners[n][s]:
                        near.setdefault(item, []).append(p)
                own = grams[a:z]
                by = np.argsort(own, kind="stable")
                ranked = own[by]
                for item, opened in near.items():
                    item_id, _, size, need, h, words, _ = self.rows[item]
                    if z - a < need:
                        continue
                    best = self._best(np.array(opened), size, h, words, ranked, by, at[a:z], starts, ends, data, n)
                    if best >= need:
                        out.append((ids[d].as_py(), tags[d].as_py(), item_id, best, need, len(h)))
            cols = list(zip(*out)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], ["doc_id", "tag", "item_id", "overlap", "needed", "n_shingles"])

    @staticmethod
    def _best(opened: np.ndarray, size: int, h: np.ndarray, words: list[bytes], ranked: np.ndarray, by: np.ndarray, at: np.ndarray, starts: np.ndarray, ends: np.ndarray, data: np.ndarray, n: int) -> int:
        """Most distinct shingles of one item in a window of its size, among positions near the opened ones."""
        lo, hi = np.searchsorted(ranked, h, "left"), np.searchsorted(ranked, h, "right")
        kind = np.repeat(np.arange(len(h)), hi - lo)
        pos = by[np.arange(len(kind)) + np.repeat(lo - np.cumsum(hi - lo) + (hi - lo), hi - lo)]
        left = np.searchsorted(opened, pos, "left")
        gap = np.minimum(np.abs(pos - opened[np.maximum(left - 1, 0)]), np.abs(opened[np.minimum(left, len(opened) - 1)] - pos))
        good = [k for k in np.flatnonzero(gap < size).tolist() if b" ".join(data[starts[w] : ends[w]].tobytes() for w in range(at[pos[k]], at[pos[k]] + n)) == words[kind[k]]]
        if not good:
            return 0
        pos, kind = pos[good], kind[good]
        order = np.argsort(pos, kind="stable")
        p, s = pos[order].tolist(), kind[order].tolist()
        count: dict[int, int] = {}
        best = first = 0
        for k, x in enumerate(s):
            count[x] = count.get(x, 0) + 1
            while p[first] <= p[k] - size:
                count[s[first]] -= 1
                if not count[s[first]]:
                    del count[s[first]]
                first += 1
            best = max(best, len(count))
        return best


def _leaks(docs: DataFrame, benchmark: DataFrame, n: int, threshold: float, block: int) -> DataFrame:
    """``(doc_id, tag, item_id, overlap, needed, n_shingles)`` of every text that holds an item."""
    if n < 1 or not 0 < threshold <= 1 or block < 1:
        raise ValueError("need n >= 1, 0 < threshold <= 1 and block >= 1")
    spark = docs.sparkSession
    items = keyed(benchmark, "item_id", "text").filter("text is not null").distinct().mapInArrow(_itemise(n), ITEM)
    items = cut(items)
    blocks = max(1, -(-(items.agg(F.sum(F.size("hashes"))).first()[0] or 0) // block))
    texts = keyed(docs, "doc_id", tag().alias("tag"), "text").filter("text is not null")
    found: DataFrame | None = None
    for b in range(blocks):
        # about ``block`` shingles by the hash of the item, so the driver holds one block at a time
        rows = sorted(items.filter(F.pmod(F.xxhash64("item_id", "hashes"), F.lit(blocks)) == b).collect(), key=lambda r: (r.item_id, r.hashes))
        if not rows:
            continue
        wanted = {k: np.unique(np.concatenate([np.array(r.hashes, np.int64).view(np.uint64) for r in rows if r.n == k])) for k in sorted({r.n for r in rows})}
        counted = texts.mapInArrow(_counter(wanted), "n int, hash bigint, texts bigint").groupBy("n", "hash").agg(F.sum("texts").alias("texts"))
        one = texts.mapInArrow(Items(rows, threshold, {(r.n, r.hash): r.texts for r in counted.collect()}).match, FOUND)
        found = one if found is None else found.unionByName(one)
    return found if found is not None else spark.createDataFrame([], FOUND)


def contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 5, threshold: float = 0.7, block: int = 1_000_000) -> DataFrame:
    """``(doc_id, item_id, overlap, needed, n_shingles)`` of every document that holds a benchmark item.

    ``overlap`` is the most distinct shingles of the item that one item-sized window holds.
    """
    top = F.max(F.struct("overlap", "n_shingles", "needed")).alias("m")
    return _leaks(docs, benchmark, n, threshold, block).groupBy("doc_id", "item_id").agg(top).select("doc_id", "item_id", "m.overlap", "m.needed", "m.n_shingles")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 5, threshold: float = 0.7, block: int = 1_000_000) -> DataFrame:
    """``docs`` without the texts that hold a benchmark item; every other row stays, repeated rows and null texts and ids included."""
    return without(docs, _leaks(docs, benchmark, n, threshold, block).select("doc_id", "tag"), repeated_ids(docs)[1])

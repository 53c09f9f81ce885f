"""Best-fit packing of documents into bins of a fixed number of tokens.

Bounded-space online best fit: at most ``open_bins`` bins are open.  A bitset has bit
``f`` set while some open bin has exactly ``f`` free tokens; the best bin for an item of
``s`` tokens is the lowest set bit at or above ``s``.  When nothing fits and the limit is
reached, the fullest bin (lowest set bit) closes.  A text longer than a bin yields full
bins of its own and one remainder, which is packed like any other item.

The stream is cut into shards by a hash of the id, ``shard_docs`` documents each on
average, so bins are a pure function of the input and a lost executor's bins come out
the same.  Only (id, token count) pairs move.

Tokens are counted exactly for a byte-level BPE vocabulary: texts are split at single
spaces between non-space characters, where the vocabulary's own pattern always splits,
and each distinct piece is counted once per worker.  With ``ranks_path`` of ``None``
a token is a byte.

Defined results
  * null text and empty text hold no tokens and take no place; null doc_id: ignored.
  * every other document counts ``extra_tokens`` more (its separator).
  * within a shard items arrive by (doc_id, tokens); equal free space is served oldest bin first.
  * repeated rows of an id with one length are separate items (with equal results in any order).
  * empty table: empty result.  Extra columns are not read.
"""

from __future__ import annotations

import base64
import re
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed

Batches = Iterator[pa.RecordBatch]
CACHE = 400_000
#: The split pattern of the byte-level vocabularies, as their library publishes it.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

SAFE = re.compile(r"(?<=\S) (?=\S)")
OTHER_SPACE = frozenset(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class TokenCounter:
    """Exact token counts; pieces are remembered, and forgotten together when there are ``CACHE`` of them."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.coder = tiktoken.Encoding("loomtrace", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        coder = self.coder

        class Spaced(dict):
            def __missing__(self, piece: str) -> int:
                n = self[piece] = len(coder.encode_ordinary(" " + piece))
                return n

        self.spaced = Spaced()

    def whole(self, text: str) -> int:
        return len(self.coder.encode_ordinary(text))

    def count(self, text: str) -> int:
        if len(self.spaced) > CACHE:
            self.spaced.clear()
        odd = "  " in text or " \n" in text or "\n " in text or text[:1] == " " or text[-1:] == " " or not OTHER_SPACE.isdisjoint(text)
        # beside white space other than the lone space, only spaces between two non-spaces are safe places
        parts = SAFE.split(text) if odd else text.split(" ")
        return self.whole(parts[0]) + sum(map(self.spaced.__getitem__, parts[1:]))


def _counting(ranks: dict[bytes, int] | None, extra: int) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        counter = TokenCounter(ranks) if ranks is not None else None
        for batch in batches:
            texts = batch.column(1)
            n = [(counter.count(t) if counter else len(t.encode())) + extra for t in (v.as_py() for v in texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], ["doc_id", "tokens"])

    return run


class BestFit:
    """One stream's open bins."""

    def __init__(self, capacity: int, open_bins: int) -> None:
        self.capacity, self.limit = capacity, open_bins
        self.bits, self.count = 0, 0
        self.free: dict[int, deque] = {}

    def _take(self, f: int) -> list:
        bins = self.free[f]
        one = bins.popleft()
        if not bins:
            del self.free[f]
            self.bits &= ~(1 << f)
        self.count -= 1
        return one

    def _put(self, f: int, one: list) -> None:
        self.free.setdefault(f, deque()).append(one)
        self.bits |= 1 << f
        self.count += 1

    def add(self, item: tuple[int, int, int]) -> list[list]:
        """Place ``(doc_id, start, length)``; returns the bins that closed, in order."""
        size, closed = item[2], []
        fits = self.bits >> size
        if fits:
            f = size + (fits & -fits).bit_length() - 1
            one = self._take(f)
        else:
            if self.count >= self.limit:
                closed.append(self._take((self.bits & -self.bits).bit_length() - 1))
            f, one = self.capacity, []
        one.append(item)
        if f == size:
            closed.append(one)
        else:
            self._put(f - size, one)
        return closed

    def finish(self) -> list[list]:
        rest = []
        while self.count:
            rest.append(self._take((self.bits & -self.bits).bit_length() - 1))
        return rest


def pieces(doc_id: int, tokens: int, capacity: int) -> list[tuple[int, int, int]]:
    return [(doc_id, at, min(capacity, tokens - at)) for at in range(0, tokens, capacity)]


def _packing(capacity: int, open_bins: int) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        shard, fit, number = None, BestFit(capacity, open_bins), 0
        out: list[tuple] = []

        def emit(bins: list[list]) -> None:
            nonlocal number
            for one in bins:
                out.append((shard, number, [i[0] for i in one], [i[1] for i in one], [i[2] for i in one], sum(i[2] for i in one)))
                number += 1

        def drain() -> pa.RecordBatch:
            cols = list(zip(*out)) or [()] * 6
            kinds = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64()]
            batch = pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], ["shard", "bin", "doc_ids", "starts", "lengths", "used"])
            out.clear()
            return batch

        for batch in batches:
            for s, doc, n in zip(*(batch.column(c).to_pylist() for c in range(3))):
                if s != shard:
                    emit(fit.finish())
                    shard, fit, number = s, BestFit(capacity, open_bins), 0
                for item in pieces(doc, n, capacity):
                    emit(fit.add(item))
            yield drain()
        emit(fit.finish())
        yield drain()

    return run


def token_counts(docs: DataFrame, ranks_path: str | None, extra_tokens: int = 1) -> DataFrame:
    """``(doc_id, tokens)`` of every document with a non-empty text.  The vocabulary file is read on the driver; its size is fixed."""
    ranks = read_ranks(ranks_path) if ranks_path else None
    texts = keyed(docs, "doc_id", "text").filter("text <> ''")
    return texts.mapInArrow(_counting(ranks, extra_tokens), "doc_id bigint, tokens bigint")


def pack(docs: DataFrame, capacity: int = 4096, open_bins: int = 256, shard_docs: int = 20_000, ranks_path: str | None = None, extra_tokens: int = 1) -> DataFrame:
    """One row per bin: ``(shard, bin, doc_ids, starts, lengths, used)``; the three lists run in parallel."""
    if capacity < 1 or open_bins < 1 or shard_docs < 1 or extra_tokens < 0:
        raise ValueError("capacity, open_bins and shard_docs must be positive")
    shards = max(1, -(-docs.count() // shard_docs))
    sized = token_counts(docs, ranks_path, extra_tokens).withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int"))
    flow = sized.select("shard", "doc_id", "tokens").repartition("shard").sortWithinPartitions("shard", "doc_id", "tokens")
    schema = "shard int, bin int, doc_ids array<bigint>, starts array<bigint>, lengths array<bigint>, used bigint"
    return flow.mapInArrow(_packing(capacity, open_bins), schema)

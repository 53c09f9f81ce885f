"""Repeated passages by a logarithmic family of suffix arrays.

The result is every place where ``length`` consecutive words also occur somewhere else: in another
document or at another place of the same one.

Suffix arrays.  Every word position that has ``length`` words before its text ends is a suffix.  Suffixes are
ordered by a fingerprint of their first ``length`` words (56 bits, told further apart by 16 more), not
alphabetically: suffixes that share ``length`` words are neighbours in either order, and this one spreads
evenly over buckets, where one common opening would fill a range of its own.

Index family.  Documents arrive in batches.  A batch's texts become sorted runs where they lie; the runs of one
bucket merge into the batch's suffix array.  It is merge-scanned, bucket by bucket, against
every level of the family: equal neighbours are matches, of new suffixes and of old ones.  Levels of
equal size merge into the next one, as carries in a binary counter do, so ``b`` batches rewrite each suffix at
most ``log2(b)`` times.  Levels are Parquet tables clustered by bucket in the family's folder, so scans and merges
move nothing; only a batch's runs are shuffled.  A family can be opened again by its folder.

Hot passages.  In a run and in a level, suffixes that share ``length`` words are one entry with its least place, and their
places are put out where the repeat is first seen, so a passage that a third of all documents hold
is one entry of each run.

Defined results
  * words are runs of letters and digits (any byte outside ASCII counts as a letter), lower-cased.
  * null or empty text, texts shorter than ``length`` words, null doc_id or one that is no whole number: no span.
  * repeated rows count once.  Further texts of an id are held against all other texts under that id;
    a place is a (doc_id, word position), so one position of two texts of an id is one place.
  * a passage that repeats within one document is a repeat, also where the two places overlap.
  * there are no ties: every place of a repeat is put out, none is preferred.
  * equal 72-bit fingerprints are taken as equal words: among 10**13 suffixes (about 100 TB) some 10**4 false
    matches are to be expected, one in 10**9.
  * empty table: empty result.  Extra columns are not read, whatever their names.
"""

from __future__ import annotations

import gc
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .common import children, keyed, remove, shared_folder

Batches = Iterator[pa.RecordBatch]
#: ``kind`` 0: a piece of a suffix array (``body``); 1: places of one document that repeat (``spots``).
ROWS = "kind int, bucket int, part int, doc_id bigint, spots array<int>, body binary"
RUN = 1 << 19
#: A bucket's array comes in ``2 ** PART_BITS`` pieces, merged one after another.
PART_BITS = 3
_SCHEMA = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("part", pa.int32()), ("doc_id", pa.int64()), ("spots", pa.list_(pa.int32())), ("body", pa.binary())])


class Entries:
    """Suffixes in order: fingerprint, check, least place (document, position) and whether it is known to repeat."""

    def __init__(self, f: np.ndarray, check: np.ndarray, doc: np.ndarray, pos: np.ndarray, twice: np.ndarray) -> None:
        self.columns = (f, check, doc, pos, twice)
        self.f, self.check, self.doc, self.pos, self.twice = self.columns

    def __len__(self) -> int:
        return len(self.f)

    def take(self, at: np.ndarray | slice) -> Entries:
        return Entries(*(c[at] for c in self.columns))

    @classmethod
    def joined(cls, parts: list[Entries]) -> Entries:
        return cls(*(np.concatenate(c) for c in zip(*(p.columns for p in parts))))

    def pack(self) -> bytes:
        """Differences of fingerprints and, of places, document numbers among the sorted ids; all as planes of bytes."""
        ids, own = np.unique(self.doc, return_inverse=True)
        planes = lambda v: np.ascontiguousarray(v.view(np.uint8).reshape(len(v), v.itemsize).T).tobytes()
        step = np.diff(self.f, prepend=np.uint64(0))
        head = np.array([len(self.f), len(ids)], np.int64).tobytes()
        parts = [step, self.check, np.diff(ids, prepend=0).view(np.uint64), own.astype(np.uint32), self.pos.astype(np.uint32), self.twice.astype(np.uint8)]
        return zstandard.ZstdCompressor(level=1).compress(head + b"".join(map(planes, parts)))

    @classmethod
    def unpack(cls, body: bytes) -> Entries:
        raw = zstandard.ZstdDecompressor().decompress(body)
        n, n_ids = np.frombuffer(raw, np.int64, 2).tolist()
        at, got = 16, []
        for kind, count in ((np.uint64, n), (np.uint16, n), (np.uint64, n_ids), (np.uint32, n), (np.uint32, n), (np.uint8, n)):
            size = np.dtype(kind).itemsize
            got.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, size * count, at).reshape(size, count).T).view(kind).reshape(-1))
            at += size * count
        step, check, gap, own, pos, twice = got
        return cls(np.cumsum(step, dtype=np.uint64), check, np.cumsum(gap, dtype=np.uint64).view(np.int64)[own], pos.astype(np.int32), twice.astype(bool))


def collapse(e: Entries) -> tuple[Entries, np.ndarray]:
    """One entry for each fingerprint, in order; and which of the given entries repeat.

    Entries repeat where their fingerprint has two different places or is already known to repeat.  Sorted runs laid
    one after another are merged, not sorted anew: the stable sort finds its runs.
    """
    by = np.argsort(e.f, kind="stable")
    f = e.f[by]
    tie = np.flatnonzero(f[1:] == f[:-1])
    if len(tie):  # only groups of equal fingerprints need a further order
        member = np.zeros(len(f), bool)
        member[tie] = member[tie + 1] = True
        at = np.flatnonzero(member)
        some = by[at]
        by[at] = some[np.lexsort((e.pos[some], e.doc[some], e.check[some], e.f[some]))]
    s = e.take(by)
    new = np.ones(len(s), bool)
    new[1:] = (s.f[1:] != s.f[:-1]) | (s.check[1:] != s.check[:-1])
    first = np.flatnonzero(new)
    if not len(first):
        return s, np.zeros(0, bool)
    moved = np.zeros(len(s), bool)
    moved[1:] = ~new[1:] & ((s.doc[1:] != s.doc[:-1]) | (s.pos[1:] != s.pos[:-1]))
    twice = np.logical_or.reduceat(s.twice | moved, first)
    repeats = np.empty(len(s), bool)
    repeats[by] = twice[np.cumsum(new) - 1]
    one = s.take(first)
    # a place that is out already is not needed again
    return Entries(one.f, one.check, np.where(twice, 0, one.doc), np.where(twice, np.int32(0), one.pos), twice), repeats


def _places(doc: np.ndarray, pos: np.ndarray, bucket: int) -> pa.RecordBatch:
    by = np.lexsort((pos, doc))
    doc, pos = doc[by], pos[by]
    edge = np.concatenate([[0], np.flatnonzero(np.diff(doc)) + 1, [len(doc)]]) if len(doc) else np.zeros(1, np.int64)
    n = len(edge) - 1
    spots = pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(pos.astype(np.int32)))
    whole = [pa.array(np.full(n, v, np.int32)) for v in (1, bucket, 0)]
    return pa.RecordBatch.from_arrays([*whole, pa.array(doc[edge[:-1]], pa.int64()), spots, pa.nulls(n, pa.binary())], schema=_SCHEMA)


def _array(bucket: int, part: int, e: Entries) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*[pa.array([v], pa.int32()) for v in (0, bucket, part)], pa.nulls(1, pa.int64()), pa.nulls(1, pa.list_(pa.int32())), pa.array([e.pack()], pa.binary())], schema=_SCHEMA)


def _runs(length: int, bits: int):
    """Sorted runs of about ``RUN`` suffixes, cut by bucket and part; places that repeat within a run are put out at once."""

    def suffixes(batches: Batches) -> Iterator[Entries]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for i, j, offs, data in K.blocks(K.lower(batch.column(1))):
                starts, ends, first = K.words(offs, data)
                h = K.span_hashes(data, starts, ends)
                f, _, edge = K.gram_hashes(h, first, length)
                check = (K.gram_hashes(K.mix(h ^ K.R), first, length)[0] >> np.uint64(48)).astype(np.uint16)
                text = np.repeat(np.arange(j - i), np.diff(edge))
                yield Entries(f & ~np.uint64(0xFF), check, ids[i:j][text], (np.arange(len(f)) - edge[text]).astype(np.int32), np.zeros(len(f), bool))

    def close(held: list[Entries]) -> Batches:
        every = Entries.joined(held)
        one, repeats = collapse(every)
        yield _places(every.doc[repeats], every.pos[repeats], 0)
        fine = bits + PART_BITS
        at = np.searchsorted(one.f >> np.uint64(64 - fine), np.arange((1 << fine) + 1, dtype=np.uint64))
        for b in np.flatnonzero(np.diff(at)).tolist():
            yield _array(b >> PART_BITS, b % (1 << PART_BITS), one.take(slice(at[b], at[b + 1])))

    def run(batches: Batches) -> Batches:
        held: list[Entries] = []
        for e in suffixes(batches):
            held.append(e)
            if sum(map(len, held)) >= RUN:
                yield from close(held)
                held = []
        if held:
            yield from close(held)

    return run


def _merged(bucket: int, sides: list[pa.Table], keep: bool) -> pa.Table:
    """Rows of a bucket's merge: its array, if that is to be kept, and the places that repeat now.  An old entry that was known to repeat is not put out again."""
    bodies: dict[int, list] = {}
    out, docs, spots = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
    for table in sides:
        arrays = table.filter(pc.equal(table.column("kind"), 0))
        for part, body in zip(arrays.column("part").to_pylist(), arrays.column("body")):
            bodies.setdefault(part, []).append(body)
        out.append(table.filter(pc.equal(table.column("kind"), 1)).cast(_SCHEMA))
    for part in sorted(bodies):
        every = Entries.joined([Entries.unpack(b.as_buffer()) for b in bodies.pop(part)])
        one, repeats = collapse(every)
        fresh = repeats & ~every.twice
        docs.append(every.doc[fresh])
        spots.append(every.pos[fresh])
        if keep:
            out.append(pa.Table.from_batches([_array(bucket, part, one)]))
    out.append(pa.Table.from_batches([_places(np.concatenate(docs), np.concatenate(spots), bucket)]))
    return pa.concat_tables(out)


def _merge_runs(key: tuple, table: pa.Table) -> pa.Table:
    return _merged(key[0].as_py(), [table], True)


def _merge_levels(keep: bool):
    def run(key: tuple, new: pa.Table, old: pa.Table) -> pa.Table:
        return _merged((key[0]).as_py(), [new, old], keep)

    return run


class Family:
    """Suffix arrays of the batches so far, as a binary counter of levels below ``folder``.

    ``levels`` maps a level's exponent to its folder's name.  What a family was made with is read back from its folder;
    a batch that was interrupted leaves the family as it was before.
    """

    def __init__(self, spark: SparkSession, folder: str, length: int = 50, bits: int = 6) -> None:
        if length < 1 or not 0 <= bits <= 24:
            raise ValueError("need length >= 1 and 0 <= bits <= 24")
        self.spark, self.folder, self.length, self.bits = spark, folder, length, bits
        self.levels: dict[int, str] = {}
        self.count = 0
        states = [c for c in children(spark, folder) if c.startswith("state-") and "_SUCCESS" in children(spark, f"{folder}/{c}")]
        if states:
            s = json.loads(spark.read.text(f"{folder}/{max(states)}").first()[0])
            self.length, self.bits, self.count, self.levels = s["length"], s["bits"], s["count"], {int(k): v for k, v in s["levels"].items()}

    def _save(self) -> None:
        state = json.dumps({"length": self.length, "bits": self.bits, "count": self.count, "levels": self.levels})
        self.spark.createDataFrame([(state,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.folder}/state-{self.count:09d}")

    def _write(self, rows: DataFrame, name: str) -> str:
        """A table clustered by bucket, arrays and places in folders of their own."""
        at = f"loomtrace_{uuid.uuid4().hex}"
        rows.write.format("parquet").mode("overwrite").partitionBy("kind").bucketBy(1 << self.bits, "bucket").option("path", f"{self.folder}/{name}").saveAsTable(at)
        self.spark.sql(f"DROP TABLE {at}")  # the files stay: the table is external
        return name

    def _open(self, name: str) -> tuple[str, DataFrame]:
        """(a table's passing name, its arrays as a clustered scan)."""
        at = f"loomtrace_{uuid.uuid4().hex}"
        kind0 = f"{self.folder}/{name}/kind=0"
        self.spark.sql(f"CREATE TABLE {at} (bucket INT, part INT, doc_id BIGINT, spots ARRAY<INT>, body BINARY) USING parquet CLUSTERED BY (bucket) INTO {1 << self.bits} BUCKETS LOCATION '{kind0}'")
        return at, self.spark.table(at).select(F.lit(0).alias("kind"), "bucket", "part", "doc_id", "spots", "body")

    def _places(self, name: str) -> list[DataFrame]:
        has = "kind=1" in children(self.spark, f"{self.folder}/{name}")
        return [self.spark.read.schema("doc_id bigint, spots array<int>").parquet(f"{self.folder}/{name}/kind=1")] if has else []

    def _meet(self, new: str, old: str, keep: bool, name: str) -> str:
        a, x = self._open(new)
        b, y = self._open(old)
        met = x.groupBy("bucket").cogroup(y.groupBy("bucket")).applyInArrow(_merge_levels(keep), ROWS)
        made = self._write(met, name)
        for t in (a, b):
            self.spark.sql(f"DROP TABLE {t}")
        return made

    def add(self, texts: DataFrame, last: bool = False) -> list[DataFrame]:
        """Index one batch of ``(doc_id, text)``; returns tables of ``(doc_id, spots)``, the places whose repeat it brings to light.

        After a ``last`` batch the family is not used again: it is merge-scanned against every level, but no level is written from it.
        """
        self.count += 1
        levels = dict(self.levels)
        runs = texts.mapInArrow(_runs(self.length, self.bits), ROWS)
        now = self._write(runs.repartition(1 << self.bits, "bucket").groupBy("bucket").applyInArrow(_merge_runs, ROWS), f"batch-{self.count:09d}")
        if "kind=0" not in children(self.spark, f"{self.folder}/{now}"):
            return []  # no text is long enough
        made, carry, stale = [now], 0, []
        while carry in levels and not last:
            stale.append(old := levels.pop(carry))
            small, now = now, self._meet(now, old, True, f"level-{carry + 1:02d}-{self.count:09d}")
            remove(self.spark, f"{self.folder}/{small}/kind=0")  # of this batch alone; old levels stay until the new state is written
            made.append(now)
            carry += 1
        for k, old in levels.items():
            made.append(self._meet(now, old, False, f"scan-{k:02d}-{self.count:09d}"))
        if last:
            stale.append(now)
        else:
            levels[carry] = now
            self.levels = levels
            self._save()
        for name in stale:  # what was merged is no longer read
            remove(self.spark, f"{self.folder}/{name}/kind=0")
        del runs
        gc.collect()  # nothing holds the batch's plan any more, so the context's cleaner frees its shuffle files
        self.spark.sparkContext._jvm.System.gc()
        return [p for name in made for p in self._places(name)]

    def drop(self) -> None:
        """Delete the levels' arrays; places stay readable."""
        for name in self.levels.values():
            remove(self.spark, f"{self.folder}/{name}/kind=0")


def _spans(length: int) -> F.Column:
    """A column function ``lists of positions -> array<struct<start, end>>``."""

    @F.arrow_udf("array<struct<start: int, end: int>>")
    def join(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for column in columns:
            out = []
            for lists in column:
                p = np.unique(np.concatenate([np.asarray(x.values) for x in lists]))
                cut = np.flatnonzero(np.diff(p) > length)
                out.append([{"start": a, "end": z + length} for a, z in zip(p[np.concatenate([[0], cut + 1])].tolist(), p[np.concatenate([cut, [len(p) - 1]])].tolist())])
            yield pa.array(out, kind)

    return join


def repeated_spans(docs: DataFrame, length: int = 50, batches: int = 4, bits: int | None = None) -> DataFrame:
    """``(doc_id, start, end, words)``: spans of words, ``end`` exclusive, made of windows of ``length`` words that occur at two places or more.

    Windows that touch or overlap are one span.  ``batches`` hashed parts of the table are added one after another; their number is
    fixed, so each suffix is rewritten ``log2(batches)`` times at every size.  There are ``2 ** bits`` buckets, by default
    as many as a shuffle has partitions; a bucket's entries are merged in one task's memory.
    """
    if batches < 1:
        raise ValueError("batches must be positive")
    spark = docs.sparkSession
    if bits is None:
        bits = max(0, (int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())
    family = Family(spark, shared_folder(spark, "suffixes"), length, bits)
    texts = keyed(docs, "doc_id", "text").filter(F.col("text").isNotNull())
    part = F.pmod(F.xxhash64("doc_id"), F.lit(batches))
    found = [p for k in range(batches) for p in family.add(texts.filter(part == k), last=k == batches - 1)]
    family.drop()
    if not found:
        return spark.createDataFrame([], "doc_id bigint, start int, end int, words int")
    every = found[0]
    for one in found[1:]:
        every = every.unionByName(one)
    spans = every.groupBy("doc_id").agg(F.collect_list("spots").alias("lists")).select("doc_id", F.explode(_spans(length)("lists")).alias("s"))
    return spans.select("doc_id", "s.start", "s.end", (F.col("s.end") - F.col("s.start")).alias("words"))

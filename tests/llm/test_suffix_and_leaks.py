"""Repeated passages and benchmark leaks against brute force."""

import os
import random
import re
from collections import defaultdict
from math import ceil

import numpy as np
import pytest

from loomtrace.llm import decontaminate, suffix_dedup

WORD = re.compile(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
EXTRA = "doc_id bigint, text string, head string, pos string, hit string, th int, shingle int, id int, start int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "a", "b", "c", 1, 2, 3, 4) for i, t in rows], EXTRA)


def words(rng, n, pool=5000):
    return [f"w{rng.randrange(pool)}" for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    passage, short = words(rng, 70), words(rng, 49)
    out = []
    for i in range(40):
        w = words(rng, rng.choice([10, 60, 200, 500]))
        if i % 3 == 0:
            at = rng.randrange(len(w))
            cut = rng.randrange(0, 25)
            w[at:at] = passage[cut:]
        if i % 4 == 0:
            w[len(w) // 2 : len(w) // 2] = short
        out.append((i, " ".join(w)))
    twice = words(rng, 60)
    out += [(50, " ".join([*twice, "between", *twice])), (51, "same " * 120), (52, "ab ba " * 80), (53, " ".join(words(rng, 40_000))), (54, ""), (55, None), (None, " ".join(passage)), (0, out[0][1]), (56, " ".join(passage[:50])), (57, " ".join(passage[:49]))]
    return [*out, (60, " ".join(passage).upper()), (61, "…".join(["é" + w for w in passage])), (62, "…".join(["É" + w for w in passage]))]


def brute_spans(rows, length):
    places = defaultdict(set)
    for i, t in rows:
        if i is None or t is None:
            continue
        w = WORD.findall(t.lower())
        for p in range(len(w) - length + 1):
            places[tuple(w[p : p + length])].add((i, p))
    cover = defaultdict(set)
    for ps in places.values():
        if len(ps) > 1:
            for i, p in ps:
                cover[i].add(p)
    out = set()
    for i, at in cover.items():
        spans = []
        for p in sorted(at):
            if spans and p <= spans[-1][1]:
                spans[-1] = (spans[-1][0], p + length)
            else:
                spans.append((p, p + length))
        out |= {(i, a, z, z - a) for a, z in spans}
    return out


@pytest.mark.parametrize("length,batches,bits,run", [(50, 4, 2, 1 << 20), (50, 1, 0, 1 << 20), (50, 5, 3, 900), (20, 3, 1, 5000), (8, 2, 2, 300)])
def test_repeated_spans(spark, rows, length, batches, bits, run, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "RUN", run)
    got = [tuple(r) for r in suffix_dedup.repeated_spans(frame(spark, rows), length, batches, bits).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute_spans(rows, length)


def test_a_family_is_a_binary_counter_and_opens_again(spark, rows, tmp_path):
    clean = [r for r in rows if r[0] is not None and r[1]]
    df = frame(spark, clean).select("doc_id", "text")
    seen = defaultdict(set)
    for k in range(7):
        family = suffix_dedup.Family(spark, str(tmp_path / "family"), *([20, 2] if not k else []))  # opened anew for each batch
        assert (family.length, family.bits, family.count) == (20, 2, k)
        for found in family.add(df.filter(f"doc_id % 7 = {k}")):
            for r in found.collect():
                seen[r.doc_id] |= set(r.spots)
        assert set(family.levels) == {b for b in range(4) if (k + 1) >> b & 1}
        # all repeats among the batches so far are out, at both of their places, and no others
        want = {(i, p) for i, a, z, _ in brute_spans([r for r in clean if r[0] % 7 <= k], 20) for p in range(a, z)}
        assert {(i, q) for i, ps in seen.items() for p in ps for q in range(p, p + 20)} == want
    levels = {n for n in os.listdir(tmp_path / "family") if os.path.isdir(tmp_path / "family" / n / "kind=0")}
    assert set(family.levels.values()) <= levels and len([n for n in levels if not n.startswith("scan")]) == 3  # merged ones are gone


def test_entries_come_back_as_packed_in_order():
    rng = np.random.default_rng(3)
    for n in (0, 1, 500):
        f = np.sort(rng.integers(0, 2**64, n, dtype=np.uint64))
        e = suffix_dedup.Entries(f, rng.integers(0, 2**16, n).astype(np.uint16), rng.integers(-(2**62), 2**62, n), rng.integers(0, 2**31, n).astype(np.int32), rng.integers(0, 2, n).astype(bool))
        back = suffix_dedup.Entries.unpack(e.pack())
        assert all((a == b).all() and a.dtype == b.dtype for a, b in zip(e.columns, back.columns))


def test_equal_fingerprints_are_told_apart():
    u = lambda *v: np.array(v, np.uint64)
    e = suffix_dedup.Entries(u(5, 5, 5, 7, 9, 9), np.array([1, 2, 1, 0, 4, 4], np.uint16), np.array([3, 3, 1, 1, 2, 2]), np.array([0, 0, 4, 5, 6, 6], np.int32), np.zeros(6, bool))
    one, repeats = suffix_dedup.collapse(e)
    assert repeats.tolist() == [True, False, True, False, False, False]  # the last two are one place; a place that is out is not kept
    assert list(zip(one.f.tolist(), one.check.tolist(), one.doc.tolist(), one.twice.tolist())) == [(5, 1, 0, True), (5, 2, 3, False), (7, 0, 1, False), (9, 4, 2, False)]


def test_no_documents(spark):
    assert suffix_dedup.repeated_spans(frame(spark, [])).count() == 0
    assert suffix_dedup.repeated_spans(frame(spark, [(1, None), (2, ""), (3, "few words only")])).count() == 0


def brute_leaks(docs, items, n, threshold):
    out = {}
    for item, it in items:
        iw = WORD.findall((it or "").lower())
        if item is None or not iw:
            continue
        k = min(n, len(iw))
        want = {tuple(iw[p : p + k]) for p in range(len(iw) - k + 1)}
        size, need = len(iw) - k + 1, ceil(threshold * len(want) - 1e-9)
        for doc, dt in docs:
            if doc is None or dt is None:
                continue
            dw = WORD.findall(dt.lower())
            grams = [tuple(dw[p : p + k]) for p in range(len(dw) - k + 1)]
            best = max((len(want & set(grams[p : p + size])) for p in range(len(grams))), default=0)
            if best >= need:
                out[(doc, item)] = max(out.get((doc, item), (0, 0, 0)), (best, len(want), need))
    return {(d, i, o, need, s) for (d, i), (o, s, need) in out.items()}


@pytest.mark.parametrize("n,threshold,block", [(5, 0.7, 10**6), (5, 0.7, 40), (3, 0.4, 10**6), (8, 1.0, 1), (1, 0.5, 100)])
def test_contaminated(spark, n, threshold, block):
    rng = random.Random(4)
    items = [(i, " ".join(words(rng, rng.choice([2, 6, 30, 60]), 300))) for i in range(12)] + [(20, ""), (21, None), (None, "a b c"), (22, "go go go go go go go go"), (3, "other text of item three that is short"), (23, "?!")]
    docs = []
    for d in range(40):
        w = words(rng, rng.choice([5, 100, 400]), 300)
        if d % 2:
            iw = (rng.choice(items[:12])[1]).split()
            for _ in range(rng.choice([0, 1, 4])):
                iw[rng.randrange(len(iw))] = "noise"
            w[len(w) // 2 : len(w) // 2] = iw
        docs.append((d, " ".join(w).title()))
    docs += [(90, None), (91, ""), (None, items[0][1]), (1, docs[1][1]), (1, items[5][1]), (92, "go " * 500), (93, " ".join(words(rng, 20_000, 300)) + " " + items[4][1])]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = [tuple(r) for r in decontaminate.contaminated(frame(spark, docs), bench, n, threshold, block).collect()]
    assert len(got) == len(set(got))
    single = brute_leaks([(k, t) if d is not None else (None, t) for k, (d, t) in enumerate(docs)], items, n, threshold)
    best = {}
    for k, item, overlap, need, size in single:
        at = (docs[k][0], item)
        best[at] = max(best.get(at, (0, 0, 0)), (overlap, size, need))
    assert set(got) == {(d, i, o, need, size) for (d, i), (o, size, need) in best.items()}
    left = decontaminate.drop_contaminated(frame(spark, docs), bench, n=n, threshold=threshold, block=block)
    assert left.columns == frame(spark, docs).columns
    want = [row for k, row in enumerate(docs) if k not in {k for k, *_ in single}]
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.text)) for r in left.collect())


def test_empty_sides(spark):
    bench = spark.createDataFrame([(1, "one two three four five six")], "item_id bigint, text string")
    assert decontaminate.contaminated(frame(spark, []), bench).count() == 0
    assert decontaminate.contaminated(frame(spark, [(1, "one two")]), bench.limit(0)).count() == 0

"""Exact and near duplicates against brute force."""

import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from loomtrace.llm import exact_dedup, kernels, minhash_dedup
from loomtrace.llm.common import components, one_row_per_text

CLASH = "hash body rep g count node tag key gone_id gone_tag ids keep_id again_id row component whole m lang"
DOCS = "doc_id bigint, text string, " + ", ".join(f"{c} string" for c in CLASH.split())


def frame(spark, rows):
    """Documents with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, *CLASH.split()) for i, t in rows], DOCS)


def prose(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "omega", "sigma", "tau", "rho"]) + str(rng.randrange(400)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    base = [prose(rng, rng.choice([3, 40, 120, 300])) for _ in range(25)]
    out = [(i, t) for i, t in enumerate(base)]
    for k in range(30):
        words = rng.choice(base).split()
        for _ in range(rng.choice([0, 1, 2, 6, 20])):
            words[rng.randrange(len(words))] = f"edit{rng.randrange(99)}"
        out.append((100 + k, " ".join(words)))
    long = prose(rng, 30_000)
    return [*out, (200, long), (201, long), (202, long + " tail"), (300, ""), (301, ""), (302, None), (303, None), (None, base[0]), (5, base[5]), (400, "!!! ... ???"), (401, "ß É ß"), (402, "SS é ss")]


def brute_exact(rows):
    low = {}
    for i, t in rows:
        if i is not None and t is not None:
            low[t] = min(i, low.get(t, i))
    return {(i, low[t]) for i, t in rows if i is not None and t is not None and low[t] != i}


@pytest.mark.parametrize("bits", [64, 3])
def test_exact_duplicates(spark, rows, bits):
    got = [tuple(r) for r in exact_dedup.exact_duplicates(frame(spark, rows), hash_bits=bits).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute_exact(rows)  # with 3 bits nearly all chunks collide and are told apart by their bytes


def test_chunks_cover_texts(rows):
    texts = [t for _, t in rows if t is not None]
    for _, _, offs, data in kernels.blocks(pa.array(texts, pa.large_string()), 5000):
        edges, counts = exact_dedup.cut_points(offs, data, 1024, 256, 8192)
        assert counts.sum() == len(edges) - 1 and set(offs.tolist()) <= set(edges.tolist())
        assert (np.diff(edges) <= 8192).all()


def test_drop_exact(spark, rows):
    left = exact_dedup.drop_exact_duplicates(frame(spark, rows))
    assert left.columns == frame(spark, rows).columns
    kept = [(r.doc_id, r.text) for r in left.collect()]
    low = {}
    for i, t in rows:
        if i is not None and t is not None:
            low[t] = min(i, low.get(t, i))
    assert sorted(map(str, kept)) == sorted(map(str, [(i, t) for t, i in low.items()] + [(i, t) for i, t in rows if i is None or t is None]))


TWICE = [(1, "a unique text of its own"), (1, "shared text of two"), (2, "shared text of two"), (3, "another unique one"), (3, "another unique one"), (4, None), (None, "shared text of two"), (4, "")]


def test_an_id_with_several_texts_loses_none(spark):
    want = {(1, "a unique text of its own"), (1, "shared text of two"), (3, "another unique one"), (4, None), (None, "shared text of two"), (4, "")}
    for drop in (exact_dedup.drop_exact_duplicates, minhash_dedup.drop_near_duplicates):
        left = drop(frame(spark, TWICE))
        got = [(r.doc_id, r.text) for r in left.collect()]
        assert set(got) == want and len(got) == len(want) and left.columns == frame(spark, TWICE).columns
    assert {tuple(r) for r in minhash_dedup.near_duplicates(frame(spark, TWICE)).collect()} == {(1, 1, 1, 0), (2, 1, 1, 0)}
    assert {tuple(r) for r in exact_dedup.exact_duplicates(frame(spark, TWICE)).collect()} == {(2, 1)}


def test_ids_that_are_no_numbers_are_left_alone(spark):
    df = spark.createDataFrame([("1", "same words here"), ("2", "same words here"), ("x", "same words here")], "doc_id string, text string")
    for drop in (exact_dedup.drop_exact_duplicates, minhash_dedup.drop_near_duplicates):
        assert {r.doc_id for r in drop(df).collect()} == {"1", "x"}


def signatures(spark, rows, **o):
    out = {}
    for r in minhash_dedup.signatures(frame(spark, rows), **o).collect():
        out.setdefault(r.doc_id, set()).add(tuple(np.array(list(r)[3:], np.int64).view(np.uint16).tolist()))
    return out


def brute_near(sigs, most):
    """``(doc_id, class_id, same_id, links)`` of single-text documents by all pairs."""
    least = {}
    for i, s in sigs.items():
        least[s] = min(i, least.get(s, i))
    near = {a: {b for b in least if a != b and sum(x != y for x, y in zip(a, b)) <= most} for a in least}
    group = {}
    for s in sorted(least, key=least.get):
        todo = [s] if s not in group else []
        while todo:
            t = todo.pop()
            if t not in group:
                group[t] = least[s]
                todo += near[t]
    return {(i, group[s], least[s], len(near[s])) for i, s in sigs.items() if near[s] or list(sigs.values()).count(s) > 1}


@pytest.mark.parametrize("most,chunks", [(20, 20), (20, 5), (7, 8), (0, 1)])
def test_near_classes_and_links_are_those_of_all_pairs(spark, rows, most, chunks):
    once = [r for r in rows if r[0] != 5 or r[1] == rows[5][1]]
    sigs = {i: next(iter(s)) for i, s in signatures(spark, once).items()}
    got = [tuple(r) for r in minhash_dedup.near_duplicates(frame(spark, once), distance=most, chunks=chunks).collect()]
    want = brute_near(sigs, most)
    assert len(got) == len(set(got)) and set(got) == want
    # dropping finds the same groups without all pairs of a bucket
    left = {r.doc_id for r in minhash_dedup.drop_near_duplicates(frame(spark, once), distance=most, chunks=chunks).collect()}
    assert left == {i for i, _ in once} - {i for i, c, _, _ in want if i != c}


def test_groups_reach_pairs_that_a_buckets_least_member_does_not(spark):
    """Texts of one bucket that are near each other but not near its least one."""
    rng = random.Random(3)
    base = prose(rng, 200).split()
    rows = []
    for i in range(40):  # a drifting family: neighbours are near, ends are far
        for _ in range(6):
            base[rng.randrange(200)] = f"new{rng.randrange(10**6)}"
        rows.append((i, " ".join(base)))
    for most, chunks in ((20, 20), (30, 6)):
        sigs = {i: next(iter(s)) for i, s in signatures(spark, rows).items()}
        want = {i for i, c, _, _ in brute_near(sigs, most) if i != c}
        left = {r.doc_id for r in minhash_dedup.drop_near_duplicates(frame(spark, rows), distance=most, chunks=chunks).collect()}
        assert left == set(range(40)) - want and want


def test_layout_allows_exactly_the_distance():
    for size, most, chunks in [(64, 20, 20), (64, 20, 5), (32, 6, 3), (16, 0, 1)]:
        parts = minhash_dedup.layout(size, most, chunks)
        assert sum(e + 1 for _, e in parts) == most + 1
        assert sorted(p for part, _ in parts for p in part) == list(range(size))


def test_near_recall_against_jaccard(spark, rows):
    def shingles(t):
        w = t.lower().split()
        return set(zip(w, w[1:])) if len(w) > 1 else {tuple(w)}

    group = {r.doc_id: r.class_id for r in minhash_dedup.near_duplicates(frame(spark, rows)).collect()}
    texts = {i: shingles(t) for i, t in rows if i is not None and t and any(c.isalnum() for c in t) and i < 300}
    pairs = [(a, b) for a, b in combinations(texts, 2) if len(texts[a] & texts[b]) / len(texts[a] | texts[b]) >= 0.8]
    assert len(pairs) > 10
    assert sum(group.get(a) == group.get(b) is not None for a, b in pairs) >= 0.9 * len(pairs)


def test_drop_near(spark, rows):
    left = {(r.doc_id, r.text) for r in minhash_dedup.drop_near_duplicates(frame(spark, rows)).collect()}
    ids = {i for i, _ in left}
    assert {200} <= ids and not {201, 202} & ids
    assert {300, 301, 302, 303, None, 400} <= ids  # nothing to compare: they stay


def test_empty_tables(spark):
    none = frame(spark, [])
    assert exact_dedup.exact_duplicates(none).count() == minhash_dedup.near_duplicates(none).count() == 0
    assert exact_dedup.drop_exact_duplicates(none).count() == minhash_dedup.drop_near_duplicates(none).count() == 0


def test_components_and_repeated_rows(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(i, i + 1) for i in range(100, 140)] + [(None, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in parent}
    df = spark.createDataFrame([(1, "b", 2), (1, "a", 3), (1, "a", 2), (2, None, 1), (2, None, 1), (None, "q", 1), (None, "q", 1)], "doc_id bigint, text string, `odd.name` int")
    got = sorted(map(str, one_row_per_text(df).collect()))
    assert got == sorted(map(str, df.filter("not (text = 'a' and `odd.name` = 3) or text is null or doc_id is null").collect()))

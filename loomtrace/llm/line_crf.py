"""Document quality from a linear-chain conditional random field over lines.

Every non-blank line is a node with two states, good and bad.  Node features describe the
line (length, character classes, repetition) and its neighbours; one transition table
links adjacent lines.  Forward-backward gives each line's marginal of being good,
and a document's quality is the mean of the marginals weighted by line length.

Training fits all weights by L-BFGS on the conditional likelihood of labelled documents,
where each line carries its document's label.  So that the transitions see good and bad lines side by
side, every good document of the sample is also spliced with a bad one, lines of the one before or after lines of the
other.  At most ``sample_docs`` labelled documents that have lines are used (the least hashes of their
ids): half of each class, or more where the other class has fewer.  Of an id with several rows one text is
used, and of a text at most ``sample_lines`` lines in a row, from a place that its hash chooses, so at most
6,000 x 200 lines of 30 small numbers, 144 MB, reach the driver; all else about the job covers
whole texts of whole tables.

Scoring is a map: no shuffle, one result for every input row.

Defined results
  * null text, empty text and text of blank lines: quality 0, no lines, not good.
  * labels that are null, or contradict each other for one id, are not trained on.
  * with fewer than two classes of labels there is no model: every line is good.  Where the labels
    hold both, but only one has documents with lines, a RuntimeWarning says so.
  * repeated rows: one equal result each; null doc_id, or one that is no whole number: scored like any other row, under null.
  * ties: a quality of exactly ``threshold`` is good.
  * empty tables: empty result.  Extra columns are not read, whatever their names (``keep_good`` passes them on).
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import cut, fresh, keyed

_CLASSES = {
    "upper": bytes(range(65, 91)),
    "digit": b"0123456789",
    "stop": b".,;:?'\"-()",
    "bang": b"!",
    "bar": b"|",
    "mark": b"#$%&*+/<=>@[\\]^_`{}~",
    "space": b" \t\r",
}
_TABLES = {k: np.isin(np.arange(256), list(v)) for k, v in _CLASSES.items()}
NEIGHBOUR = ["upper", "bang", "bar", "mark", "word_len", "repeats", "copied"]
OWN = ["log_len", *_CLASSES, "word_len", "n_words", "repeats", "copied", "ends", "opens"]
FEATURES = [*OWN, *[f"prev_{f}" for f in NEIGHBOUR], *[f"next_{f}" for f in NEIGHBOUR], "first", "last"]


def line_features(offs: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of every non-blank line, bytes of each, index of each text's first line plus the total)."""
    n_docs = len(offs) - 1
    if not len(data):
        return np.zeros((0, len(FEATURES)), np.float32), np.zeros(0, np.int64), np.zeros(n_docs + 1, np.int64)
    nl = data == 10
    cut = np.zeros(len(data) + 1, bool)
    cut[offs] = True
    before = np.concatenate([[True], nl[:-1]]) | cut[:-1]
    after = np.concatenate([nl[1:], [True]]) | cut[1:]
    starts, ends = np.flatnonzero(~nl & before), np.flatnonzero(~nl & after) + 1
    # even entries of this edge list are lines, odd ones the gaps between them; a byte of no class makes the last end an index
    edge = np.stack([starts, ends], 1).ravel()
    padded = np.append(data, np.uint8(10))

    def total(flags: np.ndarray) -> np.ndarray:
        got = np.add.reduceat(flags, edge, dtype=np.int32)[::2]
        return got

    if not len(starts):
        return np.zeros((0, len(FEATURES)), np.float32), np.zeros(0, np.int64), np.zeros(n_docs + 1, np.int64)
    size = ends - starts
    counts = {k: total(t[padded]) for k, t in _TABLES.items()}
    solid = counts["space"] < size
    starts, ends, size = starts[solid], ends[solid], size[solid]
    n = len(starts)
    first = np.searchsorted(starts, offs)
    f = {k: v[solid] / size for k, v in counts.items()}
    f["log_len"] = np.log1p(size)
    ws, we, _ = K.words(offs, data)
    wh = K.span_hashes(data, ws, we)
    wl = np.searchsorted(starts, ws, "right") - 1
    per = np.bincount(wl, minlength=n)[:n] if len(wl) else np.zeros(n, np.int64)
    f["word_len"] = np.log1p(np.bincount(wl, we - ws, minlength=n)[:n] / np.maximum(per, 1)) if len(wl) else np.zeros(n)
    f["n_words"] = np.log1p(per)
    key = np.sort((wl.astype(np.uint64) << np.uint64(32)) | (wh >> np.uint64(32)))
    fresh = np.ones(len(key), bool)
    fresh[1:] = key[1:] != key[:-1]
    kinds = np.bincount((key[fresh] >> np.uint64(32)).astype(np.int64), minlength=n)[:n] if len(key) else np.zeros(n)
    f["repeats"] = 1 - kinds / np.maximum(per, 1)
    doc = np.repeat(np.arange(n_docs), np.diff(first))
    lh = K.mix(K.span_hashes(data, starts, ends) ^ (doc.astype(np.uint64) * K.Q))
    _, back, times = np.unique(lh, return_inverse=True, return_counts=True)
    f["copied"] = (times[back] > 1).astype(float) if n else np.zeros(0)
    tail, head = data[ends - 1], data[starts]
    f["ends"] = np.isin(tail, list(b".!?")).astype(float)
    f["opens"] = (((head >= 65) & (head <= 90)) | (head >= 128)).astype(float)
    return with_neighbours(np.stack([f[name] for name in OWN], 1).astype(np.float32), first), size, first


def with_neighbours(own: np.ndarray, first: np.ndarray) -> np.ndarray:
    """All features of lines from their own ones; the first and last line of a text are their own missing neighbours."""
    n = len(own)
    is_first, is_last = np.zeros(n, bool), np.zeros(n, bool)
    some = np.flatnonzero(np.diff(first))
    is_first[first[some]] = True
    is_last[first[some + 1] - 1] = True
    shared = own[:, [OWN.index(name) for name in NEIGHBOUR]]
    before = np.where(is_first[:, None], shared, np.roll(shared, 1, 0))
    after = np.where(is_last[:, None], shared, np.roll(shared, -1, 0))
    return np.concatenate([own, before, after, is_first[:, None], is_last[:, None]], 1).astype(np.float32)


@dataclass
class Chains:
    """Lines of many documents in time-major order, longest documents first, so each step is one slice."""

    order: np.ndarray
    steps: np.ndarray

    @classmethod
    def of(cls, first: np.ndarray) -> Chains:
        length = np.diff(first)
        rank = np.argsort(-length, kind="stable")
        longest = int(length[rank[0]]) if len(rank) else 0
        active = len(length) - np.searchsorted(np.sort(length), np.arange(longest), "right")
        steps = np.concatenate([[0], np.cumsum(active)]).astype(np.int64)
        t = np.repeat(np.arange(longest), active)
        order = first[:-1][rank[np.arange(steps[-1]) - steps[t]]] + t
        return cls(order, steps)


def forward_backward(emit: np.ndarray, trans: np.ndarray, chains: Chains) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals of the good state, expected transition counts and log partition; ``emit`` is time-major log-odds of good."""
    s, e = chains.steps, np.clip(emit, -40, 40)
    top = np.maximum(e, 0)
    psi = np.stack([np.exp(-top), np.exp(e - top)], 1)
    m = np.exp(trans)
    alpha, scale = np.empty_like(psi), np.empty(len(e))
    for t in range(len(s) - 1):
        a, z = s[t], s[t + 1]
        now = psi[a:z] if t == 0 else (alpha[s[t - 1] : s[t - 1] + z - a] @ m) * psi[a:z]
        scale[a:z] = now.sum(1)
        alpha[a:z] = now / scale[a:z, None]
    beta, pairs = np.ones_like(psi), np.zeros((2, 2))
    for t in range(len(s) - 2, 0, -1):
        a, z = s[t], s[t + 1]
        w = psi[a:z] * beta[a:z] / scale[a:z, None]
        p = s[t - 1]
        beta[p : p + z - a] = w @ m.T
        pairs += alpha[p : p + z - a].T @ w * m
    both = alpha * beta
    return both[:, 1] / both.sum(1), pairs, float(np.log(scale).sum() + top.sum())


@dataclass
class Model:
    mean: np.ndarray
    std: np.ndarray
    weight: np.ndarray
    bias: float
    trans: np.ndarray

    def marginals(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        chains = Chains.of(first)
        emit = ((x - self.mean) / self.std) @ self.weight + self.bias
        good = np.empty(len(x))
        good[chains.order] = forward_backward(emit[chains.order], self.trans, chains)[0]
        return good


def fit(x: np.ndarray, first: np.ndarray, label: np.ndarray, l2: float = 1.0, rounds: int = 80) -> Model:
    """Maximum conditional likelihood with an L2 penalty, by limited-memory BFGS; ``label`` has one entry for each line."""
    mean, std = x.mean(0), np.maximum(x.std(0), 1e-3)
    chains = Chains.of(first)
    z = ((x - mean) / std)[chains.order].astype(np.float64)
    y = label[chains.order].astype(float)
    s = chains.steps
    gold = np.zeros((2, 2))
    for t in range(1, len(s) - 1):
        now, prev = y[s[t] : s[t + 1]].astype(int), y[s[t - 1] : s[t - 1] + s[t + 1] - s[t]].astype(int)
        np.add.at(gold, (prev, now), 1)
    k = z.shape[1]

    def loss(p: np.ndarray) -> tuple[float, np.ndarray]:
        trans = p[k + 1 :].reshape(2, 2)
        emit = np.clip(z @ p[:k] + p[k], -40, 40)
        good, pairs, log_z = forward_backward(emit, trans, chains)
        value = log_z - (emit * y).sum() - (gold * trans).sum() + l2 / 2 * (p @ p)
        return value, np.concatenate([z.T @ (good - y), [(good - y).sum()], (pairs - gold).ravel()]) + l2 * p

    p = np.zeros(k + 5)
    value, g = loss(p)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        d, a = g.copy(), []
        for dp, dg in reversed(past):
            a.append((dp @ d) / (dp @ dg))
            d -= a[-1] * dg
        if past:
            d *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1])
        else:
            d /= max(1.0, np.linalg.norm(g))
        for (dp, dg), w in zip(past, reversed(a)):
            d += (w - (dg @ d) / (dp @ dg)) * dp
        step = 1.0
        while step > 1e-8:
            q = p - step * d
            v, h = loss(q)
            if v <= value - 1e-4 * step * (g @ d):
                break
            step /= 2
        else:
            break
        if (q - p) @ (h - g) > 1e-10:
            past = [*past[-7:], (q - p, h - g)]
        done = value - v < 1e-6 * abs(value)
        p, value, g = q, v, h
        if done:
            break
    return Model(mean, std, p[:k], float(p[k]), p[k + 1 :].reshape(2, 2))


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = 6000, sample_lines: int = 200, l2: float = 1.0) -> Model | None:
    """Fit on a bounded sample of both classes; ``None`` where the labelled documents with lines hold fewer than two."""
    told = keyed(labels, "doc_id", "quality").filter("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("__lo"), F.max("quality").alias("__hi")).filter("__lo = __hi")
    told = told.select("doc_id", F.col("__lo").alias("label"))
    good = F.col("label") > 0
    lined = keyed(docs, "doc_id", "text").filter(F.col("text").rlike(r"[^ \t\r\n]")).select("doc_id")
    usable = cut(told.join(lined, "doc_id", "left_semi"))
    n_good, n_bad = usable.agg(F.count_if(good), F.count_if(~good)).first()
    half = max(1, sample_docs // 2)
    of = lambda mine, n, other: usable.filter(mine).orderBy(F.xxhash64("doc_id"), "doc_id").limit(min(n, max(half, sample_docs - other)))
    picked = of(good, n_good, n_bad).union(of(~good, n_bad, n_good))
    if not n_good or not n_bad:
        if told.select(good.alias("c")).distinct().count() > 1:
            warnings.warn("labels hold two classes, but the documents with lines only " + ("one" if n_good or n_bad else "none") + " of them: no model, every line is good", RuntimeWarning, stacklevel=2)
        return None

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spot = batch.column(3).to_numpy(zero_copy_only=False)
            for i, j, offs, data in K.blocks(batch.column(1)):
                x, _, first = line_features(offs, data)
                n = np.diff(first)
                fits = np.flatnonzero(n)
                k = np.minimum(n[fits], sample_lines)
                start = first[fits] + spot[i:j][fits] % (n[fits] - k + 1)
                rows = np.concatenate([np.arange(a, a + m) for a, m in zip(start, k)]) if len(fits) else np.zeros(0, np.int64)
                at = np.concatenate([[0], np.cumsum(k * len(OWN))]).astype(np.int32)
                flat = pa.ListArray.from_arrays(pa.array(at), pa.array(np.ascontiguousarray(x[rows][:, : len(OWN)]).ravel()))
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(i, j - i).take(pa.array(fits)) for c in (0, 2)], flat], ["doc_id", "label", "x"])

    # the hint is safe: the side has at most sample_docs rows of two numbers; a text is chosen of each id with map-side combine
    named = keyed(docs, "doc_id", "text").filter(F.col("text").rlike(r"[^ \t\r\n]")).join(F.broadcast(picked), "doc_id")
    chosen = named.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("m"), F.max(F.col("label").cast("int")).alias("label"))
    rows = chosen.select("doc_id", F.col("m.text").alias("text"), "label", F.pmod("m.h", F.lit(1 << 30)).alias("spot"))
    got = rows.mapInArrow(extract, "doc_id bigint, label int, x array<float>").toArrow()
    order = np.argsort(got.column("doc_id").to_numpy(), kind="stable")  # results must not hang on arrival order
    label = (got.column("label").to_numpy() > 0).astype(int)[order]
    own = [np.asarray(got.column("x")[int(d)].values, np.float32).reshape(-1, len(OWN)) for d in order]
    return fit(*spliced(own, label), l2)


def spliced(own: list[np.ndarray], label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, first lines, labels of lines) of the documents, and of one mixed text for each pair of a good and a bad one."""
    texts = [(x, np.full(len(x), y)) for x, y in zip(own, label)]
    good, bad = [t for t in texts if t[1][0]], [t for t in texts if not t[1][0]]
    for k, (a, b) in enumerate(zip(good, bad)):
        a, b = (a, b) if k % 2 else (b, a)
        m, n = (len(a[0]) + 1) // 2, (len(b[0]) + 1) // 2
        texts.append((np.concatenate([a[0][:m], b[0][-n:]]), np.concatenate([a[1][:m], b[1][-n:]])))
    first = np.concatenate([[0], np.cumsum([len(x) for x, _ in texts])])
    return with_neighbours(np.concatenate([x for x, _ in texts]), first), first, np.concatenate([y for _, y in texts])


def scorer(model: Model | None) -> F.Column:
    """A column function ``text -> struct(quality, lines, bad_lines)``."""

    @F.arrow_udf("quality double, lines int, bad_lines int")
    def score(text: pa.Array) -> pa.Array:
        quality, lines, bad = np.zeros(len(text)), np.zeros(len(text), np.int32), np.zeros(len(text), np.int32)
        for i, j, offs, data in K.blocks(text):
            x, size, first = line_features(offs, data)
            good = model.marginals(x, first) if model and len(x) else np.ones(len(x))
            some = np.flatnonzero(np.diff(first))
            if len(some):
                at = first[some]
                quality[i + some] = np.add.reduceat(good * size, at) / np.add.reduceat(size, at)
                lines[i + some] = np.diff(first)[some]
                bad[i + some] = np.add.reduceat((good < 0.5).astype(np.int32), at)
        return pa.StructArray.from_arrays([pa.array(quality), pa.array(lines), pa.array(bad)], ["quality", "lines", "bad_lines"])

    return score


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **sample: float) -> DataFrame:
    """``(doc_id, quality, lines, bad_lines, good)`` for every row of ``docs``."""
    score = scorer(train(docs, labels, **sample))
    scored = docs.select(F.col("doc_id").try_cast("bigint").alias("doc_id"), score("text").alias("q"))
    return scored.select("doc_id", F.round("q.quality", 6).alias("quality"), "q.lines", "q.bad_lines", ((F.col("q.lines") > 0) & (F.col("q.quality") >= threshold)).alias("good"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **sample: float) -> DataFrame:
    """Rows of ``docs`` whose text scores at least ``threshold``, with all their columns."""
    score, q = scorer(train(docs, labels, **sample)), fresh(docs, "quality_of_text")
    return docs.withColumn(q, score("text")).filter((F.col(f"{q}.lines") > 0) & (F.col(f"{q}.quality") >= threshold)).drop(q)

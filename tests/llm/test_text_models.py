"""Packing, line quality and language against brute force and held-out rows."""

import random
import re
from collections import Counter
from itertools import product

import numpy as np
import pyarrow as pa
import pytest
import tiktoken

from loomtrace.llm import kernels as K
from loomtrace.llm import language_id, line_crf, packing
from loomtrace.llm.queries import RANKS

EXTRA = "doc_id bigint, text string, lang string, tokens int, shard int, label int, x int, quality string, good string, language string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, 1, 2, 3, 4, "q", "g", "l") for i, t, lang in rows], EXTRA)


# -- packing


def brute_bins(items, capacity, limit):
    """Bounded best fit by search over a list of open bins, oldest first."""
    open_, closed = [], []
    for item in items:
        fits = [b for b in open_ if capacity - sum(x[2] for x in b) >= item[2]]
        if fits:
            best = min(fits, key=lambda b: capacity - sum(x[2] for x in b))
        else:
            if len(open_) >= limit:
                fullest = min(open_, key=lambda b: capacity - sum(x[2] for x in b))
                open_.remove(fullest)
                closed.append(fullest)
            best = []
            open_.append(best)
        open_.remove(best)
        best.append(item)
        if sum(x[2] for x in best) == capacity:
            closed.append(best)
        else:
            open_.append(best)  # a bin that changed is the youngest of its free space
    return closed + sorted(open_, key=lambda b: capacity - sum(x[2] for x in b))


@pytest.mark.parametrize("capacity,limit", [(50, 3), (50, 1), (200, 16), (1, 2)])
def test_best_fit_equals_search(capacity, limit):
    rng = random.Random(capacity)
    items = [x for d in range(300) for x in packing.pieces(d, rng.choice([1, 2, 7, 20, 49, 50, 51, 130]), capacity)]
    fit, got = packing.BestFit(capacity, limit), []
    for item in items:
        got += fit.add(item)
        assert fit.count <= limit and fit.bits == sum(1 << f for f in fit.free)
    got += fit.finish()
    assert [sorted(b) for b in got] == [sorted(b) for b in brute_bins(items, capacity, limit)]


def test_pack_holds_every_token_once(spark):
    rng = random.Random(1)
    rows = [(i, "word " * rng.randrange(0, 300), "en") for i in range(120)] + [(500, None, "en"), (501, "", "en"), (None, "lost", "en"), (7, "again and again", "en"), (502, "x" * 200_000, "en")]
    got = packing.pack(frame(spark, rows), capacity=256, open_bins=8, shard_docs=40).collect()
    want = sorted(x for i, t, _ in rows if i is not None and t for x in packing.pieces(i, len(t.encode()) + 1, 256))
    assert sorted(x for r in got for x in zip(r.doc_ids, r.starts, r.lengths)) == want
    assert all(r.used == sum(r.lengths) <= 256 for r in got) and len({(r.shard, r.bin) for r in got}) == len(got)
    again = packing.pack(frame(spark, rows[::-1]).repartition(3), capacity=256, open_bins=8, shard_docs=40).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert packing.pack(frame(spark, []), capacity=256).count() == 0
    # a shard's bins are those of the search over its items in order
    for shard in {r.shard for r in got}:
        items = [x for d, n in sorted((i, len(t.encode()) + 1) for i, t, _ in rows if i is not None and t and any(i in r.doc_ids for r in got if r.shard == shard)) for x in packing.pieces(d, n, 256)]
        bins = [[*zip(r.doc_ids, r.starts, r.lengths)] for r in sorted((r for r in got if r.shard == shard), key=lambda r: r.bin)]
        assert [sorted(b) for b in bins] == [sorted(b) for b in brute_bins(items, 256, 8)]


def test_token_counts_are_those_of_the_whole_text():
    ranks = packing.read_ranks(RANKS)
    counter = packing.TokenCounter(ranks)
    coder = tiktoken.Encoding("t", pat_str=packing.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    alphabet = ["a", "the", " ", " ", "  ", "\n", "\t", "\xa0", "'s", "42", "é", "über", "。", "!!", "🙂", "　", "\r\n", "\x1c", "\x85"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(4000)] + ["", " ", "a ", " a", "plain words with spaces " * 500]
    assert [counter.count(t) for t in texts] == [len(coder.encode_ordinary(t)) for t in texts]


# -- line quality


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(0)
    lengths = [1, 4, 2, 5, 3]
    first = np.concatenate([[0], np.cumsum(lengths)])
    emit, trans = rng.normal(size=first[-1]), rng.normal(size=(2, 2))
    chains = line_crf.Chains.of(first)
    good, pairs, log_z = line_crf.forward_backward(emit[chains.order], trans, chains)
    want, want_pairs, want_z = np.zeros(first[-1]), np.zeros((2, 2)), 0.0
    for a, n in zip(first, lengths):
        weights = {}
        for path in product((0, 1), repeat=n):
            weights[path] = np.exp(sum(e * s for e, s in zip(emit[a : a + n], path)) + sum(trans[s, t] for s, t in zip(path, path[1:])))
        z = sum(weights.values())
        want_z += np.log(z)
        for path, w in weights.items():
            want[a : a + n] += np.array(path) * w / z
            for s, t in zip(path, path[1:]):
                want_pairs[s, t] += w / z
    got = np.empty(first[-1])
    got[chains.order] = good
    assert np.allclose(got, want) and np.allclose(pairs, want_pairs) and np.isclose(log_z, want_z)


def test_gradient():
    rng = np.random.default_rng(1)
    n = rng.integers(1, 6, 30)
    first = np.concatenate([[0], np.cumsum(n)])
    x, label = rng.normal(size=(first[-1], len(line_crf.FEATURES))).astype(np.float32), rng.integers(0, 2, 30)
    x[:, 0] += np.repeat(label, n) * 2
    model = line_crf.fit(x, first, np.repeat(label, n))
    good = model.marginals(x, first)
    assert ((good > 0.5) == np.repeat(label, n)).mean() > 0.8


def brute_features(text):
    """A few of the features, line by line."""
    lines = [b for b in text.encode().split(b"\n") if b.strip(b" \t\r")]
    out = []
    for k, b in enumerate(lines):
        words = re.findall(rb"[0-9A-Za-z\x80-\xff]+", b)
        out.append({"log_len": np.log1p(len(b)), "digit": sum(48 <= c <= 57 for c in b) / len(b), "n_words": np.log1p(len(words)), "repeats": 1 - len(set(words)) / max(1, len(words)), "copied": float(lines.count(b) > 1), "ends": float(b[-1] in b".!?"), "first": float(k == 0), "last": float(k == len(lines) - 1)})
    for k, f in enumerate(out):
        f["prev_repeats"] = f["repeats"] if k == 0 else out[k - 1]["repeats"]
        f["next_copied"] = f["copied"] if k == len(out) - 1 else out[k + 1]["copied"]
    return out


def test_line_features():
    texts = ["One line.\nTwo 22 lines!\n\n  \nOne line.", "", "\n\n", "word word word", "é é\t\n x", "a" * 3000 + "\nb"]
    for _, _, offs, data in K.blocks(pa.array(texts, pa.large_string()), 40):
        x, size, first = line_crf.line_features(offs, data)
        at = {f: i for i, f in enumerate(line_crf.FEATURES)}
        for d in range(len(offs) - 1):
            want = brute_features(data[offs[d] : offs[d + 1]].tobytes().decode())
            assert first[d + 1] - first[d] == len(want)
            for row, w in zip(x[first[d] : first[d + 1]], want):
                assert all(np.isclose(row[at[k]], v, atol=1e-5) for k, v in w.items()), w


@pytest.fixture(scope="module")
def judged(spark):
    rng = random.Random(8)
    good = lambda: "\n".join(" ".join(rng.choice(["the", "river", "house", "and", "was", "green", "walked", "slowly"]) for _ in range(12)).capitalize() + "." for _ in range(6))
    bad = lambda: "\n".join(rng.choice(["BUY NOW!!! $$$ >>>", "click | here | home | next", "#### 1234 ==== ####"]) for _ in range(6))
    rows = [(i, good() if i % 2 else bad(), "en") for i in range(200)]
    rows += [(900, None, "en"), (901, "", "en"), (902, " \n\n", "en"), (None, good(), "en"), (3, good(), "en"), (903, "\n".join(good() for _ in range(3000)), "en")]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(100)] + [(5, 0, 0), (None, 1, 1), (7, None, 1)], "doc_id bigint, quality int, toxic int")
    return frame(spark, rows), labels


def test_quality_on_held_out_documents(judged):
    docs, labels = judged
    got = line_crf.quality(docs, labels).collect()
    assert len(got) == docs.count()
    held = [r for r in got if r.doc_id is not None and 100 <= r.doc_id < 200]
    assert sum(r.good == bool(r.doc_id % 2) for r in held) >= 0.98 * len(held)
    by = {r.doc_id: r for r in got}
    assert all(not by[i].good and by[i].lines == 0 and by[i].quality == 0 for i in (900, 901, 902))
    assert by[903].good and by[903].lines == 18_000
    kept = line_crf.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.good}


def test_a_switch_inside_a_document_is_seen(spark, judged):
    docs, labels = judged
    model = line_crf.train(docs, labels)
    assert model.trans[0, 0] + model.trans[1, 1] > model.trans[0, 1] + model.trans[1, 0]  # lines go on as they are, mostly
    good, bad = ["The river was green and the house walked slowly and the river was green."] * 5, ["BUY NOW!!! $$$ >>>"] * 5
    got = line_crf.quality(frame(spark, [(1, "\n".join(good + bad), "en"), (2, "\n".join(bad + good), "en")]), labels.limit(0)).collect()
    assert len(got) == 2
    for text, want in ((good + bad, [1] * 5 + [0] * 5), (bad + good, [0] * 5 + [1] * 5)):
        [(_, _, offs, data)] = list(K.blocks(pa.array(["\n".join(text)])))
        x, _, first = line_crf.line_features(offs, data)
        assert (model.marginals(x, first) > 0.5).astype(int).tolist() == want


def test_repeated_ids_take_one_place_in_the_sample(spark, monkeypatch):
    rows = [(i % 2, ("BUY NOW!!! $$$\n" if i % 2 else "The river was green.\n") * 3 + f"{i}", "en") for i in range(400)]
    seen = []
    real = line_crf.fit
    monkeypatch.setattr(line_crf, "fit", lambda x, first, label, l2: seen.append(len(x)) or real(x, first, label, l2))
    labels = spark.createDataFrame([(0, 1), (1, 0)], "doc_id bigint, quality int")
    line_crf.train(frame(spark, rows), labels, sample_docs=2)
    assert seen == [4 + 4 + 4]  # two documents of four lines and their splice


def test_quality_without_labels(judged):
    docs, labels = judged
    got = line_crf.quality(docs, labels.limit(0)).collect()
    assert all(r.good == (r.lines > 0) for r in got)
    assert line_crf.quality(docs.limit(0), labels).count() == 0


# -- language


@pytest.fixture(scope="module")
def tongues():
    rng = random.Random(6)
    stems = {"aa": ["kala", "mano", "tupe", "riso"], "bb": ["strg", "welk", "drun", "plit"], "cc": ["éàô", "çëî", "œuô", "àçé"]}
    return lambda lang, n: " ".join("".join(rng.choice(stems[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


class Rule:
    """The rule written word by word over strings."""

    def __init__(self, counts):
        self.languages = sorted(counts)
        self.words = self.logs(counts)
        self.grams = {n: self.logs({lang: sum((Counter({g: k * c for g, c in Counter(self.of(w, n)).items()}) for w, k in own.items()), Counter()) for lang, own in counts.items()}) for n in (5, 4, 3, 2, 1)}

    @staticmethod
    def of(word, n):
        framed = f"^{word}$" if n > 1 else word
        return [framed[i : i + n] for i in range(len(framed) - n + 1)]

    def logs(self, counts):
        keys = sorted(set().union(*counts.values()))
        total = {lang: sum(own.values()) for lang, own in counts.items()}
        most = max(total.values())
        return {k: np.array([np.log(counts[lang][k] / total[lang] if counts[lang][k] else 0.5 / most) for lang in self.languages]) for k in keys}

    def word(self, w):
        if w in self.words:
            return self.words[w]
        for n in (5, 4, 3, 2, 1):
            found = [self.grams[n][g] for g in self.of(w, n) if g in self.grams[n]]
            if found:
                return np.mean(found, 0)
        return np.zeros(len(self.languages))


def fitted(counts):
    languages = sorted(counts)
    rows = [(w, k, n) for k, lang in enumerate(languages) for w, n in counts[lang].items()]
    return language_id.fit([w for w, _, _ in rows], np.array([k for _, k, _ in rows]), np.array([n for _, _, n in rows], float), languages)


def test_scores_are_those_of_the_rule_word_by_word(tongues):
    counts = {lang: Counter(tongues(lang, 400).split()) for lang in ("aa", "bb", "cc")}
    counts["dd"] = Counter({"rare": 1})  # a language of one word keeps it
    model, rule = fitted(counts), Rule(counts)
    texts = [tongues(lang, 30) + " zzz 123 ☃ x rare rarely" for lang in ("aa", "bb", "cc")] * 5 + ["", "…", "q", "ÉÀÔ kala"]
    scorer, words = language_id.Scorer(model), re.compile(language_id.WORD)
    for i, _, offs, data in K.blocks(K.lower(pa.array(texts)), 300):
        sums, known, n = scorer.block(offs, data)
        for d in range(len(offs) - 1):
            w = words.findall(texts[i + d].lower())
            assert n[d] == len(w)
            assert np.allclose(sums[d], sum((rule.word(x) for x in w), np.zeros(4)))
            assert known[d] == sum(rule.word(x).any() for x in w)


def test_backoff_takes_the_longest_known_length():
    counts = {"aa": Counter({"abcdef": 3}), "bb": Counter({"xyz": 2})}
    scorer, rule = language_id.Scorer(fitted(counts)), Rule(counts)
    for w, n, parts in (("abcdeq", 5, ["^abcd", "abcde"]), ("qqaqq", 1, ["a"]), ("qqq", 1, [])):
        [(_, _, offs, data)] = list(K.blocks(pa.array([w])))
        sums, known, _ = scorer.block(offs, data)
        assert np.allclose(sums[0], np.mean([rule.grams[n][p] for p in parts], 0) if parts else 0) and known[0] == bool(parts)


def test_a_small_language_and_the_end_of_long_texts_are_learnt(spark):
    rng = random.Random(12)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(6))
    rows = [(i, " ".join(word("abcdefgh") for _ in range(3000)), "big") for i in range(10)] + [(50, "zuzu kiki", "small")]
    got = {r.doc_id: r.language for r in language_id.languages(frame(spark, [*rows, (90, "kiki zuzu kiki", None), (91, word("abcdefgh"), None)]), sample_chars=500).collect()}
    assert got[90] == "small" and got[91] == "big"


def test_languages_on_held_out_rows(spark, tongues):
    rows = [(i, tongues(lang, 25), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 40)]
    rows += [(500 + i, tongues(lang, 5), None) for i, lang in enumerate(["aa", "bb", "cc"] * 10)] + [(900, None, "aa"), (901, "", "bb"), (902, "... !!", None), (None, tongues("aa", 9), None), (903, tongues("bb", 50_000), None), (0, rows[0][1], "aa")]
    got = language_id.languages(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all(by[500 + i].language == lang for i, lang in enumerate(["aa", "bb", "cc"] * 10))
    assert [by[i].language for i in (900, 901, 902)] == ["und"] * 3 and by[None].language == "aa" and by[903].words == 50_000
    assert {r.language for r in language_id.languages(frame(spark, [(1, "kala", None)])).collect()} == {"und"}
    assert language_id.languages(frame(spark, [])).count() == 0

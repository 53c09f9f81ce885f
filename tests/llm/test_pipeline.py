"""The pipeline against brute force, and its stages on rows that are out of the ordinary."""

import random
from itertools import product

import numpy as np
import pyarrow as pa
import pytest
import tiktoken

import __spark_entry__
import corpus_pipeline
from loomtrace.llm import kernels as K
from loomtrace.llm import line_crf, packing
from loomtrace.llm.queries import RANKS
from tests.llm.test_exact_and_near import brute_near, signatures
from tests.llm.test_suffix_and_leaks import brute_leaks
from tests.llm.test_text_models import brute_bins

WORDS = "the river house and was green walked slowly over an old stone bridge while evening light fell".split()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables in which every stage has something to do."""
    rng = random.Random(21)
    line = lambda: " ".join(rng.choice(WORDS) + rng.choice(["", str(rng.randrange(30))]) for _ in range(14)).capitalize() + "."
    good = lambda n=5: "\n".join(line() for _ in range(n))
    bad = lambda: "\n".join(rng.choice(["BUY NOW!!! $$$ >>>", "click | here | home", "#### 1234 ====", f"WIN {rng.randrange(99)} $$$ !!!"]) for _ in range(5))
    items = [(i, line()) for i in range(6)]
    docs = [(i, good() if i % 3 else bad()) for i in range(60)]
    docs += [(100 + k, docs[k][1]) for k in (1, 2, 4, 4, 5)]  # exact copies, one in a repeated row
    for k in range(8):  # near copies
        words = docs[7 + k][1].split(" ")
        words[rng.randrange(len(words))] = "other"
        docs.append((200 + k, " ".join(words)))
    docs += [(300 + k, good(3) + "\n" + items[k][1] + "\n" + good(2)) for k in range(4)]
    docs += [(400, None), (401, ""), (None, good()), (None, bad()), (402, "\n".join(line() for _ in range(9))), (7, good(4)), (403, " \n ")]
    at = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in docs], "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(40)], "doc_id bigint, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at), docs, items


def marginals(model, text):
    """Line lengths and their marginals of being good, by enumeration of all labelings."""
    [(_, _, offs, data)] = list(K.blocks(pa.array([text])))
    x, size, _ = line_crf.line_features(offs, data)
    emit = np.clip(((x - model.mean) / model.std) @ model.weight + model.bias, -40, 40)
    total, good = 0.0, np.zeros(len(x))
    for path in product((0, 1), repeat=len(x)):
        w = np.exp(sum(e * s for e, s in zip(emit, path)) + sum(model.trans[a, b] for a, b in zip(path, path[1:])))
        total += w
        good += w * np.array(path)
    return size, good / total


def brute(spark, at, docs, items):
    """What is left after each of the first four stages, as lists of (doc_id, text)."""
    model = line_crf.train(spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet"))
    now = []
    for i, t in docs:
        if t and any(c not in " \t\r\n" for c in t):
            size, good = marginals(model, t)
            if (size * good).sum() / size.sum() >= 0.5:
                now.append((i, t))
    yield now
    low = {}
    for i, t in now:
        if i is not None:
            low[t] = min(i, low.get(t, i))
    now = [(i, t) for t, i in low.items()] + [(i, t) for i, t in now if i is None]
    yield now
    named = {k: row for k, row in enumerate(sorted((r for r in now if r[0] is not None), key=lambda r: r[0]))}
    sigs = {k: next(iter(s)) for k, s in signatures(spark, [(k, t) for k, (_, t) in named.items()]).items()}
    gone = {k for k, c, _, _ in brute_near(sigs, 20) if k != c}
    now = [row for k, row in named.items() if k not in gone] + [r for r in now if r[0] is None]
    yield now
    numbered = list(enumerate(now))
    leaky = {k for k, *_ in brute_leaks([(k, t) if row is not None else (None, t) for k, (row, t) in numbered], items, 5, 0.7)}
    now = [row for k, row in numbered if k not in leaky]
    yield now


def test_run_equals_brute_force(spark, folder):
    at, docs, items = folder
    left = list(brute(spark, at, docs, items))
    assert len(docs) > len(left[0]) > len(left[1]) > len(left[2]) > len(left[3]) > 20  # every stage has work
    now = spark.read.parquet(f"{at}/documents.parquet")
    for k, ((name, stage), want) in enumerate(zip(corpus_pipeline.STAGES, left)):
        out = stage(spark, now, at)
        assert out.columns == now.columns
        out.write.parquet(f"{at}/after-{k}.parquet")
        now = spark.read.parquet(f"{at}/after-{k}.parquet")
        assert sorted(str((r.doc_id, r.text)) for r in now.collect()) == sorted(map(str, want)), name
    coder = tiktoken.Encoding("t", pat_str=packing.PATTERN, mergeable_ranks=packing.read_ranks(RANKS), special_tokens={})
    sized = sorted((i, len(coder.encode_ordinary(t)) + 1) for i, t in left[3] if i is not None)
    bins = brute_bins([x for i, n in sized for x in packing.pieces(i, n, 4096)], 4096, 256)
    got = corpus_pipeline.run(spark, at).collect()
    assert sorted(sorted(zip(r.doc_ids, r.starts, r.lengths)) for r in got) == sorted(sorted(b) for b in bins)


def test_stages_on_empty_tables(spark, folder):
    at = folder[0]
    none = spark.read.parquet(f"{at}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, at).count() == 0, name


def test_stages_pass_on_columns_of_any_name(spark, folder):
    at = folder[0]
    names = "quality_of_text gone_id gone_tag tag again_id row node g rep __gone __q __rank shard tokens label q item_id overlap".split()
    wide = spark.read.parquet(f"{at}/documents.parquet").selectExpr("*", *[f"'{n}' AS `{n}`" for n in names], "doc_id AS `odd.name`")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, wide, at)
        assert out.columns == wide.columns, name
        assert all(r[n] == n for r in out.collect() for n in names) and all(r["odd.name"] == r.doc_id for r in out.collect()), name
    assert corpus_pipeline.STAGES[-1][1](spark, wide, at).count() > 0


def test_all_queries_are_registered():
    names = set(__spark_entry__.queries())
    assert "pipeline" in names and {int(n[2:].split("_")[0]) for n in names if n.startswith("op")} == set(range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= names

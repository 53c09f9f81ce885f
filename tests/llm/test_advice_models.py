"""Line features at the end of a block, and training samples of skewed labels."""

import numpy as np
import pyarrow as pa
import pytest

from loomtrace.llm import kernels as K
from loomtrace.llm import line_crf


def features(texts):
    [(_, _, offs, data)] = list(K.blocks(pa.array(texts)))
    return line_crf.line_features(offs, data)


@pytest.mark.parametrize("name,line", [("upper", "hI"), ("digit", "a7"), ("stop", "a."), ("bang", "Hi!"), ("bar", "a|"), ("mark", "a#"), ("space", "a ")])
def test_last_byte_of_a_block_counts(name, line):
    at = line_crf.OWN.index(name)
    alone, inside = features([line])[0], features([line, "more"])[0]
    assert alone[0, at] == inside[0, at] == np.float32(1 / len(line))
    assert features(["x\n" + line])[0][1, at] == np.float32(1 / len(line))


def test_blank_last_line_of_a_block_is_no_line():
    for blank in (" ", "  ", " \t\r ", "a\n  "):
        x, size, first = features(["word", blank])
        n = int(blank.startswith("a"))
        assert len(x) == len(size) == 1 + n and first.tolist() == [0, 1, 1 + n]


GOOD, BAD = "The river walked slowly and was green.\nThe house and the river was slow.", "BUY NOW!!! $$$ >>>\nclick | here | home | next"


def sampled(spark, rows, labels, **sample):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    told = spark.createDataFrame(labels, "doc_id bigint, quality int")
    return {r.doc_id: r.good for r in line_crf.quality(docs, told, **sample).collect()}


def test_a_rare_class_is_in_the_sample(spark):
    rows = [(i, BAD if i < 2 else GOOD) for i in range(400)] + [(1000, BAD), (1001, GOOD)]
    got = sampled(spark, rows, [(i, int(i >= 2)) for i in range(400)], sample_docs=6, sample_lines=200)
    assert not got[1000] and got[1001]


def test_a_class_of_long_documents_is_in_the_sample(spark):
    rows = [(i, "\n".join(f"BUY {k} NOW!!! $$$ >>> | {i}" for k in range(300)) if i % 2 else GOOD) for i in range(20)] + [(1000, "BUY 7 NOW!!! $$$ >>> | 4\nBUY 8 NOW!!! $$$ >>> | 5"), (1001, GOOD)]
    got = sampled(spark, rows, [(i, int(i % 2 == 0)) for i in range(20)])
    assert not got[1000] and got[1001]


def test_labels_without_documents_take_no_place(spark):
    rows = [(i, BAD if i % 2 else GOOD) for i in range(10)] + [(20, None), (21, " \n ")]
    got = sampled(spark, rows, [(i, int(i % 2 == 0)) for i in range(3000)], sample_docs=4)
    assert all(got[i] == (i % 2 == 0) for i in range(10))


def test_a_class_without_documents_is_reported(spark):
    with pytest.warns(RuntimeWarning, match="no model"):
        got = sampled(spark, [(1, GOOD), (2, BAD), (3, None)], [(1, 1), (3, 0)])
    assert got == {1: True, 2: True, 3: False}

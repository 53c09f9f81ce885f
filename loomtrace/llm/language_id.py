"""Language identification: known words first, character n-grams for the rest.

A model holds, for each language, log relative frequencies of words and of character
n-grams of 5, 4, 3, 2 and 1 characters.  A known word adds its log frequency in every
language.  An unknown word is written ``^word$`` and scored by its 5-grams if any of them is
known, else by its 4-grams, and so on down to single characters; a word of which
not even a character is known adds nothing.  The language with the greatest sum wins.

Training counts a bounded sample of labelled rows: ``sample_docs`` of them (least hashes of the id), and of each
at most ``sample_chars`` characters in a row, from a place that its hash chooses.  Every word and
n-gram of the sample is kept, of small languages as of large ones.  Counting words is a Spark job; what reaches
the driver is the sample's distinct words, and n-grams are counted there as arrays.
Scoring covers every word of every text and is a map: no shuffle, one result for every input row.
Words and n-grams are looked up by 64-bit hashes.

Defined results
  * null text, empty text, text without a letter or digit, or with no known part: ``und``, margin 0.
  * ties: the language that sorts first.
  * no labelled rows: every text is ``und``.  Null labels are not trained on.
  * an id with several texts or labels: each (id, label) that is picked is trained on with all its texts.
  * repeated rows: one equal result each; null doc_id, or one that is no whole number: scored like any other row, under null.
  * empty tables: empty result.  Extra columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import keyed

#: Runs of letters and digits; bytes outside ASCII count as letters, as in ``kernels``.
WORD = r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"
LENGTHS = (5, 4, 3, 2, 1)
CACHE = 300_000


def joined(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(edges, bytes) of words laid end to end."""
    raw = [w.encode() for w in words]
    return np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64), np.frombuffer(b"".join(raw), np.uint8)


class Framed:
    """Words written ``^word$``, and where their characters begin."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        size = ends - starts
        edge = np.concatenate([[0], np.cumsum(size + 2)])
        self.bytes = np.full(edge[-1], 94, np.uint8)
        flat = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        self.bytes[np.repeat(edge[:-1] + 1, size) + flat] = data[np.repeat(starts, size) + flat]
        self.bytes[edge[1:] - 1] = 36
        lead = (self.bytes & 0xC0) != 0x80  # bytes that begin a character
        self.chars = np.append(np.flatnonzero(lead), edge[-1])
        self.first = np.searchsorted(self.chars, edge)

    def grams(self, words: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, place in ``words``) of all ``n``-grams of some words; single characters are those inside the frame."""
        a, z = (self.first[words], self.first[words + 1]) if n > 1 else (self.first[words] + 1, self.first[words + 1] - 1)
        per = np.maximum(z - a - n + 1, 0)
        at = np.repeat(a, per) + np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
        return K.span_hashes(self.bytes, self.chars[at], self.chars[at + n]), np.repeat(np.arange(len(words)), per)


class Table:
    """Rows of numbers by 64-bit hash, found by binary search."""

    def __init__(self, hashes: np.ndarray, rows: np.ndarray) -> None:
        by = np.argsort(hashes, kind="stable")
        self.hashes, self.rows = hashes[by], rows[by]

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether each hash is there, its row number)."""
        if not len(self.hashes):
            return np.zeros(len(h), bool), np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return self.hashes[at] == h, at


def logs(hashes: np.ndarray, language: np.ndarray, counts: np.ndarray, width: int) -> Table:
    """Log relative frequencies in every language.

    What a language lacks counts as half an occurrence in the largest one, so that little text is no advantage.
    """
    keys, back = np.unique(hashes, return_inverse=True)
    rows = np.bincount(back * width + language, counts, minlength=len(keys) * width).reshape(-1, width)
    total = rows.sum(0)
    most = max(float(total.max(initial=0)), 1.0)
    return Table(keys, np.log(np.where(rows > 0, rows / np.maximum(total, 1), 0.5 / most)))


@dataclass
class Model:
    languages: list[str]
    words: Table
    grams: dict[int, Table] = field(default_factory=dict)


def fit(words: list[str], language: np.ndarray, counts: np.ndarray, languages: list[str]) -> Model:
    """A model of ``(word, index of its language, count)`` triples."""
    width, (edge, data) = max(1, len(languages)), joined(words)
    model = Model(languages, logs(K.span_hashes(data, edge[:-1], edge[1:]), language, counts, width))
    framed, every = Framed(data, edge[:-1], edge[1:]), np.arange(len(words))
    for n in LENGTHS:
        h, word = framed.grams(every, n)
        model.grams[n] = logs(h, language[word], counts[word], width)
    return model


def train(docs: DataFrame, sample_docs: int = 4000, sample_chars: int = 20_000) -> Model:
    """Count words by language over the sample."""
    told = docs.select(F.col("doc_id").try_cast("bigint").alias("doc_id"), F.col("lang").alias("lang")).filter("doc_id is not null and lang is not null").distinct()
    picked = told.orderBy(F.xxhash64("doc_id", "lang"), "doc_id", "lang").limit(sample_docs)
    # the hint is safe: the side has at most sample_docs rows
    rows = keyed(docs, "doc_id", F.col("text").alias("body"), F.col("lang").alias("own")).filter("body is not null").join(F.broadcast(picked), "doc_id").filter("own = lang").distinct()
    spare = F.greatest(F.length("body") - sample_chars, F.lit(0)) + 1
    part = F.substring("body", (F.pmod(F.xxhash64("body"), spare) + 1).cast("int"), F.lit(sample_chars))
    # one-letter runs of digits and the like are words too: what scoring sees is what is counted
    split = rows.select("lang", F.explode(F.regexp_extract_all(F.lower(part), F.lit(WORD), F.lit(0))).alias("word"))
    counted = split.groupBy("lang", "word").count().toArrow()
    lang, word, n = counted.column("lang").to_pylist(), counted.column("word").to_pylist(), counted.column("count").to_numpy()
    languages = sorted(set(lang))
    order = sorted(range(len(word)), key=lambda k: (lang[k], word[k]))
    place = {x: k for k, x in enumerate(languages)}
    return fit([word[k] for k in order], np.array([place[lang[k]] for k in order], np.int64), n[order].astype(float), languages)


class Scorer:
    """Scores of all words of a block at once: each distinct word is looked up or backed off once, and remembered."""

    def __init__(self, model: Model) -> None:
        self.width = max(1, len(model.languages))
        self.words, self.grams = model.words, model.grams
        self.forget()

    def forget(self) -> None:
        self.seen = Table(np.zeros(0, np.uint64), np.zeros((0, self.width)))
        self.seen_known = np.zeros(0, bool)

    def backoff(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(score rows, whether anything was known) of words that no vocabulary holds."""
        n_words, framed = len(starts), Framed(data, starts, ends)
        rows, known = np.zeros((n_words, self.width)), np.zeros(n_words, bool)
        todo = np.arange(n_words)
        for n in LENGTHS:
            if not len(todo):
                break
            h, word = framed.grams(todo, n)
            hit, row = self.grams[n].find(h)
            word = word[hit]
            count = np.bincount(word, minlength=len(todo))
            for c in range(self.width):
                total = np.bincount(word, self.grams[n].rows[row[hit], c], minlength=len(todo))
                rows[todo, c] = np.where(count > 0, total / np.maximum(count, 1), 0)
            known[todo[count > 0]] = True
            todo = todo[count == 0]
        return rows, known

    def block(self, offs: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sums by language, known words, words) of each text of a block."""
        starts, ends, first = K.words(offs, data)
        n = np.diff(first)
        sums, known_words = np.zeros((len(n), self.width)), np.zeros(len(n), np.int64)
        if not len(starts):
            return sums, known_words, n
        h, spot, back = np.unique(K.span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        rows, known = np.zeros((len(h), self.width)), np.zeros(len(h), bool)
        hit, at = self.words.find(h)
        rows[hit], known[hit] = self.words.rows[at[hit]], True
        rest = np.flatnonzero(~hit)
        old, at = self.seen.find(h[rest])
        rows[rest[old]], known[rest[old]] = self.seen.rows[at[old]], self.seen_known[at[old]]
        new = rest[~old]
        if len(new):
            rows[new], known[new] = self.backoff(data, starts[spot[new]], ends[spot[new]])
            if len(self.seen.hashes) + len(new) > CACHE:
                self.forget()
            hashes = np.concatenate([self.seen.hashes, h[new]])
            flags = np.concatenate([self.seen_known, known[new]])
            self.seen, self.seen_known = Table(hashes, np.concatenate([self.seen.rows, rows[new]])), flags[np.argsort(hashes, kind="stable")]
        text = np.repeat(np.arange(len(n)), n)
        for c in range(self.width):
            sums[:, c] = np.bincount(text, rows[back, c], minlength=len(n))
        return sums, np.bincount(text, known[back], minlength=len(n)).astype(np.int64), n


def scorer(model: Model) -> F.Column:
    """A column function ``text -> struct(language, margin, words)``."""
    names = [*model.languages, "und"]
    made = Scorer(model)

    @F.arrow_udf("language string, margin double, words int")
    def identify(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for text in texts:
            language, margin, words = [], np.zeros(len(text)), np.zeros(len(text), np.int32)
            for i, j, offs, data in K.blocks(K.lower(text)):
                sums, known, n = made.block(offs, data)
                best = np.where(known > 0, sums.argmax(1), len(names) - 1)
                language += [names[b] for b in best.tolist()]
                words[i:j] = n
                if sums.shape[1] > 1:
                    top = np.sort(sums, 1)
                    margin[i:j] = np.where(known > 0, (top[:, -1] - top[:, -2]) / np.maximum(n, 1), 0)
            yield pa.StructArray.from_arrays([pa.array(language, pa.string()), pa.array(margin), pa.array(words)], ["language", "margin", "words"])

    return identify


def languages(docs: DataFrame, **sample: int) -> DataFrame:
    """``(doc_id, language, margin, words)`` for every row; ``margin`` is the lead over the next language per word."""
    identify = scorer(train(docs, **sample))
    got = docs.select(F.col("doc_id").try_cast("bigint").alias("doc_id"), identify("text").alias("r"))
    return got.select("doc_id", "r.language", F.round("r.margin", 6).alias("margin"), "r.words")

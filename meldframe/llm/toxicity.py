"""Toxicity as ordinal regression: one weight per word, ordered thresholds, expected severity.

P(grade >= k) = sigmoid(w . x - t_k) with t_1 < t_2 < ...; x has log(1 + count) of the words kept by a test of association
on the training sample. Words are runs of letters of the lower-cased text, known by their 64-bit hashes, so that other words
of a long text add nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec
from .common import bounded, hashed_sample, small_batches


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of each word."""
    w = textvec.words([(t or "").lower() for t in texts], textvec.NOT_LETTERS, lower=False)
    return w.hash, np.repeat(np.arange(len(texts)), np.diff(w.first))


@dataclass
class OrdinalModel:
    words: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def __post_init__(self) -> None:
        self.sieve = np.zeros(1 << 16, bool)
        self.sieve[(self.words & np.uint64(0xFFFF)).astype(np.int64)] = True

    def counts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, feature and log(1 + count) of what the texts hold of the model's words."""
        h, doc = _words(texts)
        if not len(self.words):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        maybe = np.flatnonzero(self.sieve[(h & np.uint64(0xFFFF)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.words, h[maybe]), len(self.words) - 1)
        hit = self.words[at] == h[maybe]
        pair, n = np.unique(doc[maybe][hit] * len(self.words) + at[hit], return_counts=True)
        return pair // len(self.words), pair % len(self.words), np.log1p(n)

    def exceed(self, texts: list[str | None]) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2), ... per text."""
        doc, word, x = self.counts(texts)
        score = np.bincount(doc, self.weights[word] * x, len(texts))
        return sigmoid(score[:, None] - self.thresholds[None, :])


def associated(held: np.ndarray, row: np.ndarray, y: np.ndarray, least: int = 3, z: float = 2.6) -> tuple[np.ndarray, np.ndarray]:
    """held: the distinct words of each text, row: the text of each. Words in at least `least` texts whose log odds differ between y and the rest by z standard errors; their z."""
    every, inverse = np.unique(held, return_inverse=True)
    flag = y[row]
    n1, n0 = y.sum(), len(y) - y.sum()
    a, c = np.bincount(inverse, flag, len(every)), np.bincount(inverse, 1 - flag, len(every))
    odds = np.log((a + 0.5) / (n1 - a + 0.5)) - np.log((c + 0.5) / (n0 - c + 0.5))
    score = odds / np.sqrt(1 / (a + 0.5) + 1 / (c + 0.5))
    pick = np.flatnonzero((a + c >= least) & (np.abs(score) >= z))
    return every[pick], score[pick]


def fit(words: np.ndarray, row: np.ndarray, column: np.ndarray, x: np.ndarray, grade: np.ndarray, steps: int = 300, penalty: float = 2e-5) -> OrdinalModel:
    """Full-batch Adam on the cumulative-link likelihood of sparse features (text, word, value). Thresholds stay ordered: each is the one
    before plus exp(gap)."""
    top, d = max(1, int(grade.max(initial=1))), len(words)
    p = np.concatenate([np.zeros(d), [1.0], np.zeros(top - 1)])
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, steps + 1):
        gaps = np.exp(p[d + 1 :])
        t = p[d] + np.concatenate([[0], np.cumsum(gaps)])
        up = sigmoid(np.bincount(row, p[column] * x, len(grade))[:, None] - t[None, :])
        full = np.concatenate([np.ones((len(up), 1)), up, np.zeros((len(up), 1))], 1)
        i = np.arange(len(up))
        mass = np.maximum(full[i, grade] - full[i, grade + 1], 1e-9)
        slope = full * (1 - full)
        hi, lo = slope[i, grade] / mass, slope[i, grade + 1] / mass
        g = np.zeros_like(p)
        g[:d] = -np.bincount(column, (hi - lo)[row] * x, d) / len(up) + penalty * p[:d]
        gt = np.zeros(top + 2)
        np.add.at(gt, grade, hi)
        np.add.at(gt, grade + 1, -lo)
        gt = gt[1 : top + 1] / len(up)
        tail = np.cumsum(gt[::-1])[::-1]
        g[d], g[d + 1 :] = tail[0], tail[1:] * gaps
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return OrdinalModel(words, p[:d], p[d] + np.concatenate([[0], np.cumsum(np.exp(p[d + 1 :]))]))


def train(docs: DataFrame, labels: DataFrame, sample: int = 8000) -> OrdinalModel:
    """Fits on about `sample` labelled documents chosen by a hash of doc_id.

    Grades: 0 for toxic = 0; a toxic document has grade 1, 2 or 3 as it holds up to 1, up to 3 or more words that the labels of the other half
    of the sample set apart: what grades a document is not learnt from it. The labels have no grades of their own, so that severity means this. Null labels and ids and documents without label teach nothing, and a repeated doc_id once, by its least text and
    greatest label; without any, nothing is toxic.
    """
    known = labels.where("toxic is not null and doc_id is not null").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    few = F.broadcast(hashed_sample(known, sample, known.count(), "doc_id"))

    def held(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(rows):
            h, doc = _words(batch.column("text").to_pylist())
            first = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            per = [np.unique(h[s:e], return_counts=True) for s, e in zip(first[:-1], first[1:], strict=True)]
            ends = np.cumsum([0, *(len(w) for w, _ in per)]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([p[j] for p in per]).view(np.int64) if per else np.zeros(0, np.int64))) for j in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), *lists], names=["toxic", "words", "times"])

    rows = docs.select("doc_id", "text").join(few, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    got = rows.select("text", "toxic").mapInArrow(held, "toxic int, words array<long>, times array<long>").toArrow().combine_chunks()
    y = (got.column("toxic").to_numpy() > 0).astype(np.int64) if len(got) else np.zeros(0, np.int64)
    if not len(y) or y.min() == y.max():
        return OrdinalModel(np.zeros(0, np.uint64), np.zeros(0), np.array([20.0]))
    lists = got.column("words").chunk(0)
    row = np.repeat(np.arange(len(y)), np.diff(lists.offsets.to_numpy()))
    held_words, times = lists.flatten().to_numpy().view(np.uint64), got.column("times").chunk(0).flatten().to_numpy()
    all_row, all_times = row, times
    fold = (np.bincount(row, held_words & np.uint64(0xFF), len(y)).astype(np.int64) & 1).astype(np.int64)  # by the texts themselves
    words, _ = associated(held_words, row, y)
    at = np.minimum(np.searchsorted(words, held_words), max(0, len(words) - 1))
    ok = np.flatnonzero(words[at] == held_words) if len(words) else np.zeros(0, np.int64)
    row, column, times = row[ok], at[ok], times[ok]
    hits = np.zeros(len(y))
    for half in (0, 1):
        mine, theirs = fold == half, fold != half
        other = theirs[all_row]
        lexicon, odds = associated(held_words[other], np.cumsum(theirs)[all_row[other]] - 1, y[theirs]) if y[theirs].any() else (np.zeros(0, np.uint64), np.zeros(0))
        told = lexicon[odds > 0]
        own = mine[all_row] & np.isin(held_words, told)
        hits += np.bincount(all_row[own], all_times[own], len(y))
    grade = np.where(y == 1, np.where(hits <= 1, 1, np.where(hits <= 3, 2, 3)), 0)
    grade = np.searchsorted(np.unique(np.append(grade, 0)), grade)
    return fit(words, row, column, np.log1p(times), grade)


def score(docs: DataFrame, model: OrdinalModel, toxic_from: float = 0.4) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, expected_severity, grade (the likeliest), p_toxic = P(grade >= 1) and toxic.

    Null and empty texts and texts without a known word get what the thresholds alone say. Texts are taken whole; ids may be null
    or repeated; other columns are ignored; no rows give no rows.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(rows):
            up = model.exceed(batch.column("text").to_pylist())
            mass = np.diff(np.concatenate([np.ones((len(up), 1)), up, np.zeros((len(up), 1))], 1), axis=1) * -1
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(up.sum(1)), pa.array(mass.argmax(1).astype(np.int32)), pa.array(up[:, 0]), pa.array(up[:, 0] >= toxic_from)], names=["doc_id", "expected_severity", "grade", "p_toxic", "toxic"])

    small_batches(docs.sparkSession)
    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, expected_severity double, grade int, p_toxic double, toxic boolean")

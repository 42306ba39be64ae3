"""Quality score by a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(b + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum (v_if x_i)^2)): all pairs of features in linear time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec
from .common import bounded, hashed_sample, id_crc, small_batches
from .toxicity import sigmoid

# What a structure statistic measures, per text.
STATISTICS = ["log_bytes", "log_n_chars", "word_bytes", "upper", "digit", "mark", "exclaim", "bar", "non_ascii", "line_words", "distinct", "commonest", "repeated", "copied_lines"]
BUCKETS = 12
_UPPER = np.array([65 <= b <= 90 for b in range(256)])
_LETTER = np.array([chr(b).isalpha() or b > 127 for b in range(256)])
_DIGIT = np.array([48 <= b <= 57 for b in range(256)])
_MARK = np.array([b < 128 and not chr(b).isalnum() and not chr(b).isspace() for b in range(256)])


def features(texts: list[str | None], n_chars: list[int | None], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Statistics (texts by STATISTICS), and as a sparse matrix the hashed words: row starts, columns below 2**bits, values of length 1 a row."""
    w = textvec.words(texts, lower=False)
    n, size = len(texts), np.diff(w.at) - 1
    total = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[w.at])
    count = np.diff(w.first)
    some, words = np.maximum(size, 1), np.maximum(count, 1)
    letters = np.maximum(total(_LETTER[w.buf]), 1)
    doc = np.repeat(np.arange(n), count)
    low = textvec.words(texts).hash if total(_UPPER[w.buf]).any() else w.hash
    order = np.lexsort((low, doc)) if len(low) else np.zeros(0, np.int64)
    h, d = low[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    begin = np.flatnonzero(new)
    times, of = np.diff(np.append(begin, len(h))), d[begin]
    distinct = np.bincount(of, minlength=n)
    common = np.zeros(n)
    np.maximum.at(common, of, times)
    again = np.zeros(len(low))
    again[1:] = (low[1:] == low[:-1]) & (doc[1:] == doc[:-1])
    ends = np.flatnonzero(w.buf == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    line = textvec.span_hash(textvec.prefix_sums(w.buf), starts, ends)
    owner = np.searchsorted(w.at, starts, "right") - 1
    full = ends - starts > 20
    lines = np.bincount(owner, minlength=n)
    kept = np.bincount(owner[full], minlength=n)
    pairs = np.unique(np.stack([owner[full].astype(np.uint64), line[full]]), axis=1)[0] if full.any() else np.zeros(0, np.uint64)
    own = np.bincount(pairs.astype(np.int64), minlength=n)
    stats = np.stack([
        np.log2(1 + size), np.log2(1 + np.array([max(0, s) if c is None else max(0, c) for c, s in zip(n_chars, size, strict=True)])),
        (size - np.maximum(count - 1, 0)) / words, total(_UPPER[w.buf]) / letters, total(_DIGIT[w.buf]) / some, total(_MARK[w.buf]) / some,
        total(w.buf == 33) / some, total(w.buf == 124) / some, total(w.buf > 127) / some, count / np.maximum(lines, 1),
        distinct / words, common / words, np.bincount(doc, again, n) / words, 1 - own / np.maximum(kept, 1),
    ], 1)
    first = np.searchsorted(of, np.arange(n + 1))
    value = np.log1p(times)
    norm = np.sqrt(np.bincount(of, value * value, n))
    return stats, first, (h[begin] & np.uint64((1 << bits) - 1)).astype(np.int64), value / norm[of]


@dataclass
class FactorisationMachine:
    bits: int
    edges: np.ndarray
    bias: float
    w: np.ndarray
    v: np.ndarray

    def rows(self, stats: np.ndarray, first: np.ndarray, column: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row numbers, columns and values, the statistics being one column for each bucket."""
        n, k = stats.shape
        bucket = np.stack([np.searchsorted(self.edges[j], stats[:, j], "right") for j in range(k)], 1)
        extra = (1 << self.bits) + np.arange(k)[None, :] * (BUCKETS + 1) + bucket
        row = np.concatenate([np.repeat(np.arange(n), np.diff(first)), np.repeat(np.arange(n), k)])
        return row, np.concatenate([column, extra.ravel()]), np.concatenate([value, np.full(n * k, 0.5)])

    def raw(self, n: int, row: np.ndarray, column: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores before the sigmoid, and the sums that gradients need."""
        linear = np.bincount(row, self.w[column] * value, n)
        sums = np.empty((n, self.v.shape[1]))
        pairs = np.zeros(n)
        for f in range(self.v.shape[1]):
            each = self.v[column, f] * value
            sums[:, f] = np.bincount(row, each, n)
            pairs += sums[:, f] ** 2 - np.bincount(row, each * each, n)
        return self.bias + linear + 0.5 * pairs, sums


def train(docs: DataFrame, labels: DataFrame, sample: int = 6000, bits: int = 15, rank: int = 4, epochs: int = 8, batch: int = 128) -> FactorisationMachine:
    """Fits by Adam on about `sample` labelled rows chosen by a hash of doc_id, of those whose crc32(doc_id as text) mod 5 is not 0.
    Null labels and ids teach nothing, a repeated doc_id once, by its least text and label; without labels every score is that of the bias, 0.5."""
    known = labels.where("quality is not null and doc_id is not null").where(id_crc() % 5 != 0).select("doc_id", F.col("quality").cast("int").alias("quality"))
    few = F.broadcast(hashed_sample(known, sample, known.count(), "doc_id"))

    def extract(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(rows):
            stats, first, column, value = features(b.column("text").to_pylist(), b.column("n_chars").to_pylist(), bits)
            cut = lambda x: [x[s:e].tolist() for s, e in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_pydict({"y": b.column("quality"), "stats": stats.tolist(), "columns": cut(column), "vals": cut(value)})

    few = _columns(docs).join(few, "doc_id").groupBy("doc_id").agg(F.min(F.struct("text", "n_chars")).alias("d"), F.min("quality").alias("quality")).select("d.text", "d.n_chars", "quality")
    got = few.mapInArrow(extract, "y int, stats array<double>, columns array<long>, vals array<double>").toArrow()
    size = (1 << bits) + len(STATISTICS) * (BUCKETS + 1)
    rng = np.random.default_rng(7)
    fm = FactorisationMachine(bits, np.zeros((len(STATISTICS), BUCKETS)), 0.0, np.zeros(size), rng.normal(0, 0.02, (size, rank)))
    if not len(got):
        fm.v[:] = 0
        return fm
    y = (got.column("y").to_numpy() > 0).astype(float)
    stats = np.array(got.column("stats").to_pylist())
    fm.edges = np.quantile(stats, np.linspace(0, 1, BUCKETS + 2)[1:-1], axis=0).T
    lists = got.column("columns").to_pylist()
    first = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    column = np.concatenate([np.array(x, np.int64) for x in lists] + [np.zeros(0, np.int64)])
    value = np.concatenate([np.array(x, float) for x in got.column("vals").to_pylist()] + [np.zeros(0)])
    row, column, value = fm.rows(stats, first, column, value)
    order = np.argsort(row, kind="stable")
    row, column, value = row[order], column[order], value[order]
    begin = np.searchsorted(row, np.arange(len(y) + 1))
    params = [fm.w[:, None], fm.v]
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    step = 0
    for _ in range(epochs):
        shuffled = rng.permutation(len(y))
        for s in range(0, len(y), batch):
            step += 1
            pick = shuffled[s : s + batch]
            at = np.concatenate([np.arange(begin[i], begin[i + 1]) for i in pick])
            r = np.repeat(np.arange(len(pick)), begin[pick + 1] - begin[pick])
            c, x = column[at], value[at]
            raw, sums = fm.raw(len(pick), r, c, x)
            err = (sigmoid(raw) - y[pick]) / len(pick)
            fm.bias -= 0.05 * err.sum()
            cols, to = np.unique(c, return_inverse=True)
            g_w = np.bincount(to, err[r] * x)[:, None]
            g_v = np.stack([np.bincount(to, err[r] * x * (sums[r, f] - fm.v[c, f] * x)) for f in range(rank)], 1)
            for p, (m, v), g in zip(params, state, (g_w, g_v), strict=True):
                g = g + 1e-5 * p[cols]
                m[cols] = 0.9 * m[cols] + 0.1 * g
                v[cols] = 0.99 * v[cols] + 0.01 * g * g
                p[cols] -= 0.02 * m[cols] / (np.sqrt(v[cols]) + 1e-6)
    return fm


def _columns(docs: DataFrame) -> DataFrame:
    n = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), n.alias("n_chars"))


def score(docs: DataFrame, model: FactorisationMachine, good_from: float = 0.3) -> DataFrame:
    """Per row of docs (doc_id, text, n_chars if there): doc_id, held_out, score and predicted.

    Null texts are empty; empty texts are scored by their statistics; a null n_chars counts as the text's length in bytes. Texts are
    taken whole; ids may be repeated; a null id is held out of training but has a null held_out. Other columns are ignored; no rows give no rows.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(rows):
            stats, *words = features(b.column("text").to_pylist(), b.column("n_chars").to_pylist(), model.bits)
            p = sigmoid(model.raw(b.num_rows, *model.rows(stats, *words))[0])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(p), pa.array((p >= good_from).astype(np.int32))], names=["doc_id", "score", "predicted"])

    small_batches(docs.sparkSession)
    out = _columns(docs).mapInArrow(run, "doc_id long, score double, predicted int")
    return out.select("doc_id", (id_crc() % 5 == 0).alias("held_out"), "score", "predicted")

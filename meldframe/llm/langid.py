"""Language identification by unigrams over a fixed public piece vocabulary, all segmentations summed.

Each language has a probability for every piece. P(word) is the sum over all ways to cut the word into pieces, by the forward
algorithm over byte positions; a text's log likelihood is the sum over its words. Probabilities come from EM on the word
counts of a bounded training sample. Words are runs of letters of the lower-cased text, led by the word mark.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec
from .common import bounded, discard, id_crc, small_batches, stored
from .pieces import MARK, codec

UNKNOWN = "und"
#: Bytes of a word that EM takes at once; a longer run of letters is taken in parts of so many.
CUT = 64


class Vocabulary:
    """Pieces as byte strings. A piece with the word mark fits only at a word's start, the others everywhere; single bytes are always there.

    Hashes of spans are looked up in two tables; the second holds those that met another in the first.
    """

    def __init__(self, path: str) -> None:
        sp = codec(path).sp
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        keys = {(p.startswith(MARK), p.lstrip(MARK).lower().encode()) for p in pieces if p.count(MARK) <= 1 and MARK not in p[1:]}
        keys = {k for k in keys if k[1]} | {(m, bytes([b])) for b in range(256) for m in (False, True)}
        self.size, self.longest = len(keys), max(len(k) for _, k in keys)
        #: Lengths that some piece has; a word has no arcs of others.
        self.lengths = sorted({len(k) for _, k in keys})
        data = sorted(keys)
        hashes = np.array([textvec.bytes_hash(k) for _, k in data], np.uint64) ^ np.array([self.first if m else 0 for m, _ in data], np.uint64)
        self.slots = [np.full(1 << 19, -1, np.int32), np.full(1 << 18, -1, np.int32)]
        self.shifts = [45, 0]
        self.keys = hashes
        at = self._slot(hashes, 0)
        _, lone = np.unique(at, return_index=True)
        self.slots[0][at[lone]] = lone
        left = np.setdiff1d(np.arange(self.size), lone)
        while len(np.unique(at := self._slot(hashes[left], 1))) < len(left):
            self.shifts[1] += 1
            if self.shifts[1] == 46:
                raise ValueError("no shift parts the vocabulary's hashes")
        self.slots[1][at] = left

    first = 0x5851F42D4C957F2D

    def _slot(self, h: np.ndarray, i: int) -> np.ndarray:
        return ((h >> np.uint64(self.shifts[i])) & np.uint64(len(self.slots[i]) - 1)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Number of the piece of each hash, -1 without one."""
        out = self.slots[0][self._slot(h, 0)]
        some = np.flatnonzero(out >= 0)
        other = some[self.keys[out[some]] != h[some]]
        again = self.slots[1][self._slot(h[other], 1)]
        out[other] = np.where((again >= 0) & (self.keys[again] == h[other]), again, -1)
        return out


_VOCABULARY: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _VOCABULARY:
        _VOCABULARY[path] = Vocabulary(path)
    return _VOCABULARY[path]


def lattice(vocab: Vocabulary, sums: np.ndarray, start: np.ndarray, length: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, words, pieces) of all pieces that fit into words of one length, by ascending end."""
    for to in range(1, length + 1):
        for at in (to - n for n in reversed(vocab.lengths) if n <= to):
            h = textvec.span_hash(sums, start + at, start + to)
            for marked in (False, True) if at == 0 else (False,):
                piece = vocab.find(h ^ np.uint64(vocab.first) if marked else h)
                hit = np.flatnonzero(piece >= 0)
                if len(hit):
                    yield at, to, hit, piece[hit]


def forward(vocab: Vocabulary, logp: np.ndarray, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Log probability of each word in each language. Words are taken by length, so that a step is one array operation for all of them."""
    p = np.exp(logp)
    sums, size = textvec.prefix_sums(buf), end - start
    out = np.zeros((len(start), p.shape[1]))
    order = np.argsort(size, kind="stable")
    cuts = np.flatnonzero(np.diff(size[order])) + 1
    most = max(1, 4_000_000 // p.shape[1])
    for group in np.split(order, cuts) if len(order) else ():
        n = int(size[group[0]])
        each = max(1, most // (vocab.longest + 1))
        for pick in (group[i : i + each] for i in range(0, len(group), each)):
            ring = [np.zeros((len(pick), p.shape[1])) for _ in range(vocab.longest + 1)]
            ring[0][:] = 1
            scale = np.zeros((len(pick), p.shape[1]))
            now = 0
            for at, to, words, pieces in lattice(vocab, sums, start[pick], n):
                if to != now:
                    now = to
                    if to % 24 == 0:  # keeps long words within the range of doubles
                        top = ring[(to - 1) % len(ring)].copy()
                        scale += np.log(top)
                        for r in ring:
                            r /= top
                    ring[to % len(ring)][:] = 0
                ring[to % len(ring)][words] += ring[at % len(ring)][words] * p[pieces]
            out[pick] = np.log(ring[n % len(ring)]) + scale
    return out


def expectation(vocab: Vocabulary, logp: np.ndarray, buf: np.ndarray, start: np.ndarray, end: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in each language, given word counts by language."""
    p, sums, size = np.exp(logp), textvec.prefix_sums(buf), end - start
    out = np.zeros_like(p)
    order = np.argsort(size, kind="stable")
    groups = np.split(order, np.flatnonzero(np.diff(size[order])) + 1) if len(order) else ()
    for pick in (g[i : i + each] for g in groups for each in [max(1, 2_000_000 // (int(size[g[0]]) * p.shape[1] + 1))] for i in range(0, len(g), each)):
        n = int(size[pick[0]])
        if n > CUT:  # beyond the range of doubles: in parts, as such words are none
            for s in range(0, n, CUT):
                out += expectation(vocab, logp, buf, start[pick] + s, np.minimum(start[pick] + s + CUT, end[pick]), counts[pick])
            continue
        arcs = list(lattice(vocab, sums, start[pick], n))
        a, b = np.zeros((2, n + 1, len(pick), p.shape[1]))
        a[0] = b[n] = 1
        for at, to, w, q in arcs:
            a[to][w] += a[at][w] * p[q]
        for at, to, w, q in reversed(arcs):
            b[at][w] += b[to][w] * p[q]
        share = counts[pick] / np.maximum(a[n], 1e-300)
        for at, to, w, q in arcs:
            use = a[at][w] * p[q] * b[to][w] * share[w]
            for j in range(p.shape[1]):
                out[:, j] += np.bincount(q, use[:, j], len(out))
    return out


@dataclass
class LanguageModel:
    path: str
    langs: list[str]
    logp: np.ndarray

    def likelihoods(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log likelihood of each text in each language, and its numbers of words and of characters in words. Each distinct word of the batch is scored once."""
        w = textvec.words([(t or "").lower() for t in texts], textvec.NOT_LETTERS, lower=False)
        _, one, of = np.unique(w.hash, return_index=True, return_inverse=True)
        each = forward(vocabulary(self.path), self.logp, w.buf, w.start[one], w.end[one])
        doc = np.repeat(np.arange(len(texts)), np.diff(w.first))
        like = np.stack([np.bincount(doc, each[of, j], len(texts)) for j in range(len(self.langs))], 1)
        before = np.concatenate([[0], np.cumsum((w.buf & 0xC0) != 0x80)])
        return like, np.diff(w.first), np.bincount(doc, before[w.end] - before[w.start], len(texts))

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text, as predict() below has them."""
        return self.judge(texts)[:2]

    def judge(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Language and score of each text, the language's number, the text's log likelihood in that language per character of its words, and those characters."""
        some = np.array([any(c.isalpha() for c in t or "") for t in texts], bool)
        if not self.langs or not some.any():
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), np.int64), np.zeros(len(texts)), np.zeros(len(texts))
        like, n, size = self.likelihoods(texts)
        best = like.argmax(1)
        rate = like[np.arange(len(texts)), best] / np.maximum(size, 1)
        like = (like - like.max(1, keepdims=True)) * (1 / (1 + np.sqrt(n / 32)))[:, None]
        return [self.langs[b] if ok else UNKNOWN for b, ok in zip(best, some, strict=True)], np.where(some, 1 / np.exp(like).sum(1), 0.0), best, rate, size


def _sampled(docs: DataFrame, sample: int | None) -> tuple[list[str], DataFrame]:
    """The languages and the training documents (lang, text): about `sample` of each language, or all."""
    known = docs.where("lang is not null and text is not null and doc_id is not null").where(id_crc() % 4 != 2)
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not sizes:
        return [], known.select("lang", "text")
    if sample is None:
        return sorted(sizes), known.select("lang", "text")
    rates = F.create_map(*(F.lit(x) for k in sorted(sizes) for x in (k, min(1.0, sample / sizes[k]))))
    unit = (F.xxhash64(F.lit(77), "doc_id").bitwiseAND(0xFFFFFF)) / float(1 << 24)
    return sorted(sizes), known.where(unit < rates[F.col("lang")]).select("lang", "text")


@dataclass
class Limits:
    """How far a text's log likelihood per character may lie under its language's mean: `most`, and for short texts, which vary more, `short` standard
    deviations more. For each language mean and variance of a character."""

    mean: np.ndarray
    varies: np.ndarray
    most: float
    short: float = 8.0

    def hold(self, best: np.ndarray, rate: np.ndarray, size: np.ndarray) -> np.ndarray:
        return (size == 0) | (self.mean[best] - rate <= self.most + self.short * np.sqrt(self.varies[best] / np.maximum(size, 1)))


def limits(docs: DataFrame, model: LanguageModel, sample: int | None = None, margin: float = 3.0, share: float = 0.999) -> Limits:
    """Learns from the training documents that train() takes what log likelihood per character texts of their languages have: a text may lie as far
    under the mean as `margin` times what `share` of the longer half do. Medians and shares are of all these documents, by Spark's percentile_approx: with up
    to 10,000 or 100,000 values they are values of the documents, beyond that within 1 / 10,000 or 1 / 100,000 of the rank. Without training documents every text holds."""
    langs, picked = _sampled(docs, sample)

    def judged(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(rows):
            _, _, best, rate, size = model.judge(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_pydict({"best": best.astype(np.int64), "rate": rate, "size": size.astype(np.float64)})

    n = max(1, len(langs))
    out = Limits(np.zeros(n), np.ones(n), np.inf)
    if not langs:
        return out
    small_batches(docs.sparkSession)
    got = stored(picked.mapInArrow(judged, "best long, rate double, size double").where("size > 0"), "judged")
    means = got.groupBy("best").agg((F.sum(F.col("rate") * F.col("size")) / F.sum("size")).alias("mean"))
    for r in means.collect():
        out.mean[r["best"]] = r["mean"]
    under = F.element_at(F.array(*(F.lit(float(m)) for m in out.mean)), F.col("best").cast("int") + 1) - F.col("rate")
    got_under = got.select("best", "size", under.alias("under"))
    for r in got_under.groupBy("best").agg(F.percentile_approx(F.col("under") * F.col("under") * F.col("size"), 0.5, 10_000).alias("median")).collect():
        out.varies[r["best"]] = r["median"] / 0.455  # the median of a squared standard normal
    middle = got.agg(F.percentile_approx("size", 0.5, 10_000)).first()[0]
    if middle is not None:
        out.most = margin * max(0.3, got_under.where(F.col("size") >= middle).agg(F.percentile_approx("under", share, 100_000)).first()[0])
    discard(got)
    return out


#: Distinct words that EM on the executors takes at once.
_WORDS = 20_000


def _learnt(counted: DataFrame, path: str, langs: list[str], rounds: int) -> np.ndarray:
    """Log probabilities by EM over a stored table of all words (lang, word, n): each round is a pass in which tasks add up the expected uses of the pieces, so
    that the driver holds numbers by piece and language, whatever the number of words."""
    size, of = vocabulary(path).size, {x: j for j, x in enumerate(langs)}
    logp = np.full((size, len(langs)), -np.log(size))
    for _ in range(rounds):

        def uses(rows: Iterator[pa.RecordBatch], logp: np.ndarray = logp) -> Iterator[pa.RecordBatch]:
            total, words, cells, times = np.zeros_like(logp), [], [], []

            def add() -> None:
                counts = np.zeros((len(words), len(langs)))
                counts[np.arange(len(words)), cells] = times
                ends = np.cumsum([len(w) + 1 for w in words]) - 1
                buf = np.frombuffer(b" ".join(words) + b" ", np.uint8)
                total[:] += expectation(vocabulary(path), logp, buf, ends - np.array([len(w) for w in words], np.int64), ends, counts)
                for x in (words, cells, times):
                    x.clear()

            for b in rows:
                words += b.column("word").to_pylist()
                cells += [of[x] for x in b.column("lang").to_pylist()]
                times += b.column("n").to_pylist()
                if len(words) >= _WORDS:
                    add()
            if words:
                add()
            piece, lang = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(piece.astype(np.int32)), pa.array(lang.astype(np.int32)), pa.array(total[piece, lang])], names=["piece", "lang", "uses"])

        summed = counted.mapInArrow(uses, "piece int, lang int, uses double").groupBy("piece", "lang").agg(F.sum("uses").alias("uses")).toArrow()
        every = np.full_like(logp, 0.01)
        # rounded, as sums differ in their last digits by the order of tasks
        every[summed.column("piece").to_numpy(), summed.column("lang").to_numpy()] += np.round(summed.column("uses").to_numpy(), 6)
        logp = np.log(every / every.sum(0))
    return logp


def train_on_all(docs: DataFrame, path: str, rounds: int = 4) -> LanguageModel:
    """As train(), from every document with a language whose crc32(doc_id as text) mod 4 is not 2. Words are counted by batch and then by Spark."""
    langs, picked = _sampled(docs, None)
    if not langs:
        return LanguageModel(path, langs, np.full((vocabulary(path).size, 0), 0.0))

    def words(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(rows):
            w = textvec.words([(t or "").lower() for t in batch.column("text").to_pylist()], textvec.NOT_LETTERS, lower=False)
            raw, said = w.buf.tobytes(), np.repeat(np.array([langs.index(x) for x in batch.column("lang").to_pylist()], np.int64), np.diff(w.first))
            for j, lang in enumerate(langs):
                own = np.flatnonzero(said == j)
                _, one, n = np.unique(w.hash[own], return_index=True, return_counts=True)
                each = [raw[s:e] for s, e in zip(w.start[own[one]].tolist(), w.end[own[one]].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(each), pa.string()), pa.array(each, pa.binary()), pa.array(n.astype(np.int64))], names=["lang", "word", "n"])

    small_batches(docs.sparkSession)
    counted = stored(picked.mapInArrow(words, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    logp = _learnt(counted, path, langs, rounds)
    discard(counted)
    return LanguageModel(path, langs, logp)


def train(docs: DataFrame, path: str, sample: int = 400, rounds: int = 4) -> LanguageModel:
    """Learns from text and lang of documents with a language whose crc32(doc_id as text) mod 4 is not 2.

    Takes about `sample` such documents of each language, chosen by a hash of doc_id, with all their text. Without labelled documents the model has no language and everything is unknown.
    """
    langs, picked = _sampled(docs, sample)
    vocab = vocabulary(path)
    logp = np.full((vocab.size, len(langs)), -np.log(vocab.size))
    if not langs:
        return LanguageModel(path, langs, logp)

    def words(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(rows):
            w = textvec.words([(t or "").lower() for t in batch.column("text").to_pylist()], textvec.NOT_LETTERS, lower=False)
            raw = w.buf.tobytes()
            said = [raw[s:e] for s, e in zip(w.start.tolist(), w.end.tolist(), strict=True)]
            yield pa.RecordBatch.from_pydict({"lang": np.repeat(np.array(batch.column("lang").to_pylist(), object), np.diff(w.first)), "word": pa.array(said, pa.binary())})

    got = picked.mapInArrow(words, "lang string, word binary").groupBy("lang", "word").count().toArrow()
    said = got.column("word").to_pylist()
    every = sorted(set(said))
    at = {w: i for i, w in enumerate(every)}
    counts = np.zeros((len(every), len(langs)))
    np.add.at(counts, ([at[w] for w in said], [langs.index(x) for x in got.column("lang").to_pylist()]), got.column("count").to_numpy())
    buf = np.frombuffer(b" ".join(every) + b" ", np.uint8)
    end = np.cumsum([len(w) + 1 for w in every]) - 1 if every else np.zeros(0, np.int64)
    start = end - np.array([len(w) for w in every], np.int64)
    for _ in range(rounds):
        uses = expectation(vocab, logp, buf, start, end, counts) + 0.01
        logp = np.log(uses / uses.sum(0))
    return LanguageModel(path, langs, logp)


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, held_out, lang_pred, score.

    score is the posterior of the predicted language among the learned ones, equally likely before; differences of log
    likelihood are divided by 1 + sqrt(n / 32) for n words, which are far from independent, so that long texts don't all get 1. Null texts and those without a letter are `und` with score 0. Ties
    go to the first language by name. Texts are taken whole; rows may repeat; a null doc_id has a null held_out; other columns, lang
    among them, are not read; no rows give no rows.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(rows):
            said, score = model.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(said, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    small_batches(docs.sparkSession)
    out = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", (id_crc() % 4 == 2).alias("held_out"), "lang_pred", "score")

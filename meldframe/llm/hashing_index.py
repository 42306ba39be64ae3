"""Approximate nearest neighbours by multi-index hashing.

Vectors become binary codes: signs after learned rotations (iterative quantisation, some rotations side by side). A code falls into
substrings of 8 bits, each indexed by value as bitmaps of rows. A code within Hamming distance R of a query has, by the pigeonhole
principle, a substring within R // substrings of the query's, so probing all values that near in each index retrieves every code within R.
What the full codes confirm is reranked by the inner product of the original vectors. R is learned: the least that holds the
wanted share of true neighbours in the fitting sample. Larger norms are taken into one more coordinate, so that inner products
become angles.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import hashed_sample

_NEAR = np.array([[int(a ^ b).bit_count() for b in range(256)] for a in range(256)], np.uint8)


@dataclass
class Codes:
    """Rotations (each dimensions + 1 square), the largest norm, and the Hamming radius."""

    rotations: list[np.ndarray]
    norm: float
    radius: int

    @property
    def substrings(self) -> int:
        """Bytes of a code without its padding."""
        return (sum(r.shape[1] for r in self.rotations) + 7) // 8

    def _lifted(self, x: np.ndarray, query: bool) -> np.ndarray:
        scale = np.linalg.norm(x, axis=1, keepdims=True) if query else self.norm
        x = x / scale
        rest = np.zeros((len(x), 1)) if query else np.sqrt(np.maximum(0, 1 - (x * x).sum(1, keepdims=True)))
        return np.concatenate([x, rest], 1)

    def encode(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """Packed codes, padded with zero bytes to a multiple of 8 a row for hamming()."""
        lifted = self._lifted(x, query)
        bits = np.concatenate([lifted @ r > 0 for r in self.rotations], 1)
        packed = np.packbits(bits, 1)
        return np.ascontiguousarray(np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))))


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64)).sum(-1, dtype=np.int64)


def fit(x: np.ndarray, norm: float, rotations: int = 4, rounds: int = 15, queries: int = 200, near: int = 20, recall: float = 0.97) -> Codes:
    """Learns rotations by alternating signs and orthogonal fits, and the radius from sample queries and their exact neighbours."""
    rng = np.random.default_rng(11)
    codes = Codes([], norm, 0)
    lifted = codes._lifted(x, False)
    for _ in range(rotations):
        r = np.linalg.qr(rng.normal(size=(lifted.shape[1], lifted.shape[1])))[0]
        for _ in range(rounds):
            u, _, v = np.linalg.svd(lifted.T @ np.where(lifted @ r > 0, 1.0, -1.0))
            r = u @ v
        codes.rotations.append(r)
    base, asked = codes.encode(x), rng.permutation(len(x))[:queries]
    far = []
    for i, q in zip(asked, codes.encode(x[asked], True), strict=True):
        score = x @ x[i]
        score[i] = -np.inf
        far.append(hamming(base[np.argsort(-score)[: min(near, len(x) - 1)]], q))
    codes.radius = int(np.quantile(np.concatenate(far), recall)) + 1 if len(x) > 1 else 0
    return codes


class Block:
    """The indexes of some rows: for each substring and value a bitmap of the rows within the probing radius of it."""

    def __init__(self, codes: Codes, ids: np.ndarray, x: np.ndarray) -> None:
        self.codes, self.ids, self.x = codes, ids, x
        self.code = codes.encode(x)
        self.balls: dict[int, np.ndarray] = {}

    def _ball(self, reach: int) -> np.ndarray:
        """Substrings by values by bitmap: OR of the postings of all values within reach of the value."""
        if reach not in self.balls:
            m = self.codes.substrings
            width = (len(self.ids) + 7) // 8
            out = np.zeros((m, 256, width), np.uint8)
            for s in range(m):
                postings = np.packbits(self.code[:, s][None, :] == np.arange(256, dtype=np.uint8)[:, None], axis=1)
                held = np.flatnonzero(postings.any(1))
                for v in range(256):
                    probes = held[_NEAR[v][held] <= reach]
                    if len(probes):
                        np.bitwise_or.reduce(postings[probes], axis=0, out=out[s, v])
            self.balls[reach] = out
        return self.balls[reach]

    def probed(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows with a substring within radius // substrings of the code's: all within radius are among them."""
        m = self.codes.substrings
        ball = self._ball(min(8, radius // m))
        return np.flatnonzero(np.unpackbits(np.bitwise_or.reduce(ball[np.arange(m), code[:m]], axis=0), count=len(self.ids)))

    def search(self, own: int, q: np.ndarray, code: np.ndarray, near: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and inner products of the best rows but those of the query's own id. The radius grows until there are enough."""
        m, radius = self.codes.substrings, self.codes.radius
        while True:
            rows = self.probed(code, radius)
            rows = rows[(hamming(self.code[rows], code) <= radius) & (self.ids[rows] != own)]
            if len(rows) >= near or radius >= 8 * m:
                break
            radius += m
        score = (self.x[rows] * q).sum(1)
        best = np.lexsort((self.ids[rows], -score))[:near]
        return self.ids[rows[best]], score[best]


def usable(vector: str) -> Column:
    """Neither null nor zero, and all components finite."""
    v = F.col(vector).cast("array<double>")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.col(vector).isNotNull() & ~bad & F.exists(v, lambda c: c != 0)


def _matrix(t: pa.Table) -> np.ndarray:
    lists = t.column("v").combine_chunks()
    flat = lists.flatten().to_numpy()
    return flat.reshape(t.num_rows, -1) if t.num_rows else flat.reshape(0, 1)


def search(vectors: DataFrame, is_query: Column, near: int = 20, sample: int = 10_000, rows: int = 8192, queries: int = 512) -> DataFrame:
    """Nearest rows of vectors (vec_id, embedding) by inner product for those where is_query: query_id, rank, vec_id, score.

    Codes are fitted on about `sample` rows chosen by a hash of vec_id; every row is indexed. Rows and queries meet in blocks of about `rows`
    and `queries`, dealt by hash, so that no task grows with the table; the best of each block are merged. Ties go to the smaller vec_id.
    Null, zero and non-finite vectors and null ids take no part. Vectors of another length than a query's have no product with it: each length is
    searched by itself, with codes of its own. Repeated rows are candidates each, but
    not for their own id. Other columns are ignored. Without queries or other rows the result is empty.
    """
    spark = vectors.sparkSession
    every = vectors.where(usable("embedding") & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), is_query.alias("asked"))
    sizes = every.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c))).alias("norm"), F.sum(F.col("asked").cast("long")).alias("q")).orderBy(F.desc("n"), "d").collect()
    found = [_search(every.where(F.size("v") == s["d"]), s, near, sample, rows, queries) for s in sizes if s["q"]]
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")


def _search(every: DataFrame, sizes: Row, near: int, sample: int, rows: int, queries: int) -> DataFrame:
    """search() among vectors (vec_id, v, asked) of one length; sizes has their number n, their largest norm, and the number q of queries."""
    codes = fit(_matrix(hashed_sample(every.select("vec_id", "v"), sample, sizes["n"], "vec_id").toArrow()), sizes["norm"])
    n_rows, n_queries = math.ceil(sizes["n"] / rows), math.ceil(sizes["q"] / queries)
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    left = every.select("vec_id", "v", dealt(n_rows).alias("r"), spread(n_queries).alias("s"))
    right = every.where("asked").select("vec_id", "v", spread(n_rows).alias("r"), dealt(n_queries).alias("s"))

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        out: dict[str, list[np.ndarray]] = {"query_id": [], "vec_id": [], "score": []}
        if a.num_rows and b.num_rows:
            block = Block(codes, a.column("vec_id").to_numpy(), _matrix(a))
            ask = _matrix(b)
            for own, q, code in zip(b.column("vec_id").to_numpy(), ask, codes.encode(ask, True), strict=True):
                ids, score = block.search(own, q, code, near)
                out["query_id"].append(np.full(len(ids), own))
                out["vec_id"].append(ids)
                out["score"].append(score)
        cat = lambda k, t: pa.array(np.concatenate([*out[k], np.zeros(0, t)]).astype(t))
        return pa.table({"query_id": cat("query_id", np.int64), "vec_id": cat("vec_id", np.int64), "score": cat("score", np.float64)})

    best = left.groupBy("r", "s").cogroup(right.groupBy("r", "s")).applyInArrow(meet, "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= near).select("query_id", "rank", "vec_id", "score")

"""Connected components of a graph of links: DataFrame rounds with a written table after each, until the graph fits into one task of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored

#: Links that one task holds at most: 16 MB of them.
FITS = 1 << 20


def smallest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All nodes of links (u, v) and the smallest node that each reaches."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    label = np.arange(len(nodes))
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (label[label] != label).any():
            label = label[label]
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    return nodes, nodes[label]


def _solved(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in rows]
    if parts:
        node, component = smallest(*(np.concatenate(p) for p in zip(*parts, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(component)], names=["node", "component"])


def components(links: DataFrame, rounds: int = 60, fits: int = FITS) -> DataFrame:
    """(a, b) links to (node, component), component being the smallest node reachable.

    More links than `fits` go through alternating large-star and small-star steps: each hangs the neighbours of a node on the smallest one,
    so a hub of any degree costs its degree, and rounds grow with the logarithm of the size of a component. Once they fit, one task ends it.
    The result is a table in the shared folder; those of the rounds are gone. Null ends and links of a node with itself are ignored; without
    links the result is empty.
    """
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v")).distinct(), "edges")
    seen = None
    for _ in range(rounds):
        if edges.count() <= fits:
            out = stored(edges.repartition(1).mapInArrow(_solved, "node long, component long"), "merge")
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        before, edges = edges, stored(small.select("e.*").where("u <> v").distinct(), "edges")
        discard(before)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
            out = stored(nodes.unionByName(nodes.select(F.col("component").alias("node"), "component").distinct()), "merge")
            break
        seen = now
    else:
        raise RuntimeError(f"no fixed point after {rounds} rounds")
    discard(edges)
    return out

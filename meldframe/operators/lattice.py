"""Merging replicas as aggregation.

State is kept exploded, a row for each atom of a lattice, so that a merge of any number of replicas is a union and one groupBy whose
partial sums Spark makes before the shuffle. Merges commute and may see an atom any number of times.

lww      pk, col, ts, value (bytes)
counter  pk, col, node, inc, dec
orset    pk, col, elem, tag      and tombstones pk, col, tag, ts
rga      pk, col, id, value, origin, ts, deleted, deleted_at
file     pk, col, ts, path, hash, size
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ("pk", "col")
# Spark schemas of the state tables.
STATES = {
    "lww": "pk string, col string, ts bigint, value binary",
    "counter": "pk string, col string, node string, inc bigint, dec bigint",
    "orset": "pk string, col string, elem binary, tag string",
    "tombstone": "pk string, col string, tag string, ts bigint",
    "rga": "pk string, col string, id string, value binary, origin string, ts bigint, deleted boolean, deleted_at bigint",
    "file": "pk string, col string, ts bigint, path string, hash string, size bigint",
}


def union(states: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), states)


def _winner(order: Column, *fields: str) -> Column:
    return F.min(F.struct(order.alias("_late"), *fields))


def merge_lww(state: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The write with the greatest ts; of equal ones that with the smaller value, byte by byte."""
    best = state.groupBy(*keys).agg(_winner(-F.col("ts"), "value", "ts").alias("w"))
    return best.select(*keys, F.col("w.ts").alias("ts"), F.col("w.value").alias("value"))


def merge_file(state: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """As merge_lww, ties by the metadata as canonical JSON."""
    meta = F.to_json(F.struct("path", "hash", "size"))
    best = state.withColumn("_meta", meta).groupBy(*keys).agg(_winner(-F.col("ts"), "_meta", "path", "hash", "size", "ts").alias("w"))
    return best.select(*keys, *(F.col(f"w.{c}").alias(c) for c in ("ts", "path", "hash", "size")))


def merge_counter(state: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Each node's greatest sums. A node is the replica that writes, so that none adds to another's sums."""
    return state.groupBy(*keys, "node").agg(F.max("inc").alias("inc"), F.max("dec").alias("dec"))


def counter_value(merged: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return merged.groupBy(*keys).agg((F.sum("inc") - F.sum("dec")).cast("long").alias("value"))


def merge_tombstones(tombstones: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return tombstones.groupBy(*keys, "tag").agg(F.max("ts").alias("ts"))


def merge_orset(tags: DataFrame, tombstones: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The tags of all replicas that no replica has removed. Both sides are dealt by (keys, tag) once."""
    return tags.join(merge_tombstones(tombstones, keys), [*keys, "tag"], "left_anti").select(*keys, "elem", "tag").distinct()


def orset_elements(live: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return live.select(*keys, "elem").distinct()


def orset_contains(live: DataFrame, elem: Column, keys: Sequence[str] = KEYS) -> DataFrame:
    """Per key whether the set has the element."""
    return live.groupBy(*keys).agg(F.bool_or(F.col("elem") == elem).alias("contains"))


def merge_rga(vertices: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """One row for each vertex: deleted if any replica deleted it, at the earliest known time above 0."""
    at = F.min(F.when(F.col("deleted_at") > 0, F.col("deleted_at")))
    return vertices.groupBy(*keys, "id").agg(
        F.min("value").alias("value"), F.min("origin").alias("origin"), F.max("ts").alias("ts"),
        F.bool_or("deleted").alias("deleted"), F.coalesce(at, F.lit(0)).cast("long").alias("deleted_at"),
    )


MERGES = {"lww": merge_lww, "file": merge_file, "counter": merge_counter, "tombstone": merge_tombstones, "rga": merge_rga}


def merge_row(parts: dict[str, Sequence[DataFrame]]) -> dict[str, DataFrame]:
    """Rows of columns of any type: state tables by type, each from any number of replicas, merged. A column must have one type throughout:
    see conflicts()."""
    out = {k: MERGES[k](union(v)) for k, v in parts.items() if k in MERGES and v}
    if parts.get("orset"):
        tags = union(parts["orset"])
        dead = out.get("tombstone", tags.sparkSession.createDataFrame([], STATES["tombstone"]))
        out["orset"] = merge_orset(tags, dead)
    return out


def conflicts(parts: dict[str, DataFrame]) -> DataFrame:
    """Columns (pk, col) that have atoms of more than one type. Taking either would depend on the merge's order, so they are an error."""
    every = union([d.select(*KEYS, F.lit(k).alias("kind")) for k, d in parts.items() if k != "tombstone"])
    return every.groupBy(*KEYS).agg(F.min("kind").alias("one"), F.max("kind").alias("other")).where("one <> other")


def gc_orset(tags: DataFrame, tombstones: DataFrame, safe_ts: int, keys: Sequence[str] = KEYS) -> tuple[DataFrame, DataFrame]:
    """Tags and tombstones without those removed before safe_ts."""
    old = tombstones.where(F.col("ts") < safe_ts).select(*keys, "tag").distinct()
    return tags.join(old, [*keys, "tag"], "left_anti"), tombstones.where(F.col("ts") >= safe_ts)


def gc_rga(vertices: DataFrame, safe_ts: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Vertices without the leaves deleted before safe_ts: one pass, as a leaf's parent becomes a leaf only thereby."""
    parents = vertices.select(*keys, F.col("origin").alias("id")).distinct()
    old = vertices.where("deleted and deleted_at > 0").where(F.col("deleted_at") < safe_ts)
    gone = old.join(parents, [*keys, "id"], "left_anti").select(*keys, "id")
    return vertices.join(gone, [*keys, "id"], "left_anti")


def wide_lww(merged: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Rows pk and one typed column for each of columns (name: logical type), from merged LWW state; a missing column is null."""
    from ..functions.coerce import loaded

    picked = merged.where(F.col("col").isin(list(columns))).groupBy("pk")
    cells = picked.agg(*(F.max(F.when(F.col("col") == c, F.col("value"))).alias(f"_{i}") for i, c in enumerate(columns)))
    return cells.select("pk", *(loaded(F.col(f"_{i}"), kind).alias(c) for i, (c, kind) in enumerate(columns.items())))

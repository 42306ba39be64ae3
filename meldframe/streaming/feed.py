"""Streams of an operation log: merging it batch by batch, and feeds of what changed."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import lattice

OPLOG = "seq bigint, tbl string, pk string, col string, kind string, ts bigint, value binary, node string, inc bigint, dec bigint, elem binary, tag string, id string, origin string, deleted boolean, deleted_at bigint, path string, hash string, size bigint, source string"


def read_log(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    """The log as a stream. Rows come as files do; none are dropped when many come at once."""
    return spark.readStream.schema(OPLOG).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def atoms(log: DataFrame, kind: str) -> DataFrame:
    """The log's operations of one kind as atoms of its lattice."""
    names = [c.split()[0] for c in lattice.STATES[kind].split(", ")]
    return log.where(F.col("kind") == kind).select(*names)


def changes(log: DataFrame, tables: Sequence[str] = (), columns: Sequence[str] = (), local_only: bool = False, replica: str | None = None) -> DataFrame:
    """Changed cells of a log, streamed or not: those of local writes, or also what came from other replicas."""
    out = log.where(F.col("tbl").isin(list(tables))) if tables else log
    if columns:  # an event without a column concerns all of them
        out = out.where(F.col("col").isNull() | F.col("col").isin(list(columns)))
    if local_only:
        out = out.where(F.col("source") == replica)
    return out.select("seq", "tbl", "pk", "col", "kind", "source")


def since(feed: DataFrame, after: int, latest_only: bool = False) -> DataFrame:
    """Events after a sequence number; latest_only: the last of them alone, as for one who waits for any change."""
    out = feed.where(F.col("seq") > after)
    return out.orderBy(F.desc("seq")).limit(1) if latest_only else out


def wait_for_change(read: Callable[[], DataFrame], after: int, seconds: float = 30, pause: float = 0.2):
    """The latest event after a sequence number, as soon as there is one; None when the time is over."""
    end = time.monotonic() + seconds
    while True:
        row = since(read(), after, True).first()
        if row is not None or time.monotonic() >= end:
            return row
        time.sleep(pause)


def merge_stream(log: DataFrame, kind: str, read: Callable[[], DataFrame | None], write: Callable[[DataFrame], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Merges the log's operations of one kind into a state table that is written whole by each batch, for small states; merge_into() appends to a database's.
    A batch that is repeated after a failure changes nothing, and late operations count as any other: there is no watermark. Tags are collected here,
    tombstones are a kind of their own."""

    def batch(rows: DataFrame, _: int) -> None:
        new, old = atoms(rows, kind), read()
        merged = lattice.union([new] if old is None else [old, new])
        write(lattice.MERGES[kind](merged) if kind in lattice.MERGES else merged.distinct())

    out = log.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out).start()


def merge_into(log: DataFrame, table, kinds: Sequence[str], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Merges the log's operations of some kinds into a database's table: each batch appends one segment of each kind, so that its cost follows the
    batch and not the state, and tags and tombstones of one log are applied together. A repeated batch changes nothing."""

    def batch(rows: DataFrame, _: int) -> None:
        rows = rows.where(F.col("tbl") == table.schema.name).persist()  # one read of the files for all kinds
        table.merge({k: atoms(rows, k) for k in kinds}, peer="log")
        rows.unpersist()

    out = log.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out).start()


def progress(query: StreamingQuery) -> dict[str, float]:
    """Rows and rates of the last batch."""
    last = query.lastProgress or {}
    return {k: last.get(k) or 0 for k in ("numInputRows", "inputRowsPerSecond", "processedRowsPerSecond", "batchId")}

"""Helpers shared by the training-data operators: where shared tables go, bounded samples, Arrow settings."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset one under /tmp if all runs on this machine, else an error."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = "/tmp/checkpoints"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(at)
    return at


def stored(df: DataFrame, name: str, *keys: str) -> DataFrame:
    """Writes df to a fresh table in the shared folder and reads it back: cuts the lineage and outlives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/meldframe/{name}-{uuid.uuid4().hex}"
    (df.repartition(*keys) if keys else df).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that stored() wrote, when nothing reads them any more."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.stored_at)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def small_batches(spark: SparkSession, rows: int = 400) -> None:
    """Arrow batches of so many rows at most, so that a Python worker holds a few MB of text at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def bounded(batches: Iterator[pa.RecordBatch], most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """The batches, parted so that each has `most` bytes of text or a single row: numpy's working memory is a multiple of that, and textvec keeps two
    arrays of the next power of two of 8 bytes."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        start = total = 0
        for i, n in enumerate(size.tolist()):
            if total + n > most and i > start:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        yield batch.slice(start)


def id_crc(col: str = "doc_id") -> Column:
    """crc32 of the id written as decimal text."""
    return F.crc32(F.col(col).cast("string").cast("binary"))


def hashed_sample(df: DataFrame, n: int, total: int, key: str) -> DataFrame:
    """The n of total rows with the least hashes of key: the same on every run and however the rows are parted. A sieve leaves about 1.5 n to sort."""
    hashed = F.xxhash64(F.lit(77), key).bitwiseAND(0xFFFFFFFF)
    cut = 2**32 if total <= 1.5 * n else math.ceil((1.5 * n + 100) / total * 2**32)
    return df.withColumn("_hash", hashed).where(F.col("_hash") < cut).orderBy("_hash", key).limit(n).drop("_hash")


def rows_where(docs: DataFrame, keep: Callable[[list[str | None]], np.ndarray]) -> DataFrame:
    """The rows of docs, with all their columns, for whose texts keep() is true: a pass over the table without a join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            yield batch.filter(pa.array(keep(batch.column("text").to_pylist()), pa.bool_()))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def few(df: DataFrame, most: int = 32 << 20) -> DataFrame:
    """df, to be broadcast if its values have so many bytes at most; else as it is, to be shuffled."""
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)) if t in ("string", "binary") else F.lit(16 if t.startswith("decimal") else 8) for c, t in df.dtypes), F.lit(0))
    return F.broadcast(df) if (df.agg(F.sum(size.cast("long"))).first()[0] or 0) <= most else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

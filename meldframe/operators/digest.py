"""Digests of rows and Merkle trees over them, as column expressions and four groupBys.

Rows are hashed over their canonical, sorted atoms, so that equal states have equal digests on every replica. Leaves are the rows that
share the first four hexadecimal digits of their key; each further level groups by one digit less.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEPTH = 4
ROW_TAG, NODE_TAG = "00", "01"


def row_digests(atoms: DataFrame, columns: Sequence[str], pk: str = "pk") -> DataFrame:
    """pk and the SHA-256 (hex) of the row's atoms: each atom's columns as JSON, sorted, joined by line breaks."""
    atom = F.to_json(F.array(*(F.col(c).cast("string") for c in columns)))
    return atoms.groupBy(pk).agg(F.sha2(F.array_join(F.sort_array(F.collect_set(atom)), "\n"), 256).alias("digest"))


def _hash_of(parts: Column) -> Column:
    """SHA-256 of an array of byte strings (hex) in a row: joined once, so that the cost is that of their length."""
    return F.sha2(F.unhex(F.array_join(parts, "")), 256)


def leaves(rows: DataFrame) -> DataFrame:
    """rows: key (hex, in key order), digest (hex). Gives level, prefix, hash of the leaves: SHA-256 of 00, key and digest of each row in key order."""
    one = F.struct("key", F.concat(F.lit(ROW_TAG), "key", "digest").alias("bytes"))
    of = rows.groupBy(F.substring("key", 1, DEPTH).alias("prefix")).agg(F.sort_array(F.collect_list(one)).alias("rows"))
    return of.select(F.lit(DEPTH).alias("level"), "prefix", _hash_of(F.transform("rows", lambda r: r["bytes"])).alias("hash"))


def parents(nodes: DataFrame) -> DataFrame:
    """The level above: SHA-256 of 01, digit and hash of each child in order of digits; at most 16 children each."""
    digit = F.substring("prefix", -1, 1)
    one = F.struct(digit.alias("digit"), F.concat(F.lit(NODE_TAG), F.hex(digit), "hash").alias("bytes"))
    up = nodes.select((F.col("level") - 1).alias("level"), F.expr("substring(prefix, 1, length(prefix) - 1)").alias("prefix"), one.alias("c"))
    of = up.groupBy("level", "prefix").agg(F.sort_array(F.collect_list("c")).alias("c"))
    return of.select("level", "prefix", _hash_of(F.transform("c", lambda c: c["bytes"])).alias("hash"))


def tree(rows: DataFrame) -> DataFrame:
    """All levels, leaves to root. An empty table has no nodes; root() is then the empty text."""
    return above(leaves(rows))


def stored_tree(rows: DataFrame, folder: str) -> DataFrame:
    """tree(), its leaves written to the folder first: the four levels above are made of these few rows (16**DEPTH at most), not of all rows again,
    and so is what is done with the tree."""
    return above(_written(leaves(rows), folder))


def _written(level: DataFrame, folder: str) -> DataFrame:
    at = f"{folder}/leaves-{uuid.uuid4().hex}"
    level.write.parquet(at)
    return level.sparkSession.read.parquet(at)


def above(level: DataFrame) -> DataFrame:
    """Leaves with all the levels above them. Few rows: 16**DEPTH leaves at most, so that each level is one small aggregation of the one below."""
    out = level
    for _ in range(DEPTH):
        level = parents(level)
        out = out.unionByName(level)
    return out


def node(nodes: DataFrame, prefix: str) -> str:
    """A node's hash; the empty text if there is none."""
    row = nodes.where((F.col("level") == len(prefix)) & (F.col("prefix") == prefix)).first()
    return row["hash"] if row else ""


def leaf_rows(rows: DataFrame, prefix: str) -> DataFrame:
    """The rows (key, digest) of one leaf in key order."""
    return rows.where(F.col("key").startswith(prefix)).select("key", "digest").orderBy("key")


def root(nodes: DataFrame) -> str:
    row = nodes.where("level = 0").first()
    return row["hash"] if row else ""


def children(nodes: DataFrame, prefix: str) -> DataFrame:
    return nodes.where((F.col("level") == len(prefix) + 1) & F.col("prefix").startswith(prefix))


def refreshed(nodes: DataFrame, rows: DataFrame, touched: DataFrame, folder: str | None = None) -> DataFrame:
    """The tree after the rows with the keys of touched changed: only their leaves are made of rows anew. All leaves, few as they are, then give the levels
    above; with a folder they are written there first, so that rows are read once."""
    stale = touched.select(F.substring("key", 1, DEPTH).alias("prefix")).distinct()
    fresh = leaves(rows.withColumn("prefix", F.substring("key", 1, DEPTH)).join(stale, "prefix", "left_semi"))
    kept = nodes.where(F.col("level") == DEPTH).join(stale, "prefix", "left_anti").select("level", "prefix", "hash")
    return above(_written(kept.unionByName(fresh), folder) if folder else kept.unionByName(fresh))


def tree_diff(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """Nodes that differ or that one side lacks: level, prefix, mine, theirs."""
    a, b = mine.withColumnRenamed("hash", "mine"), theirs.withColumnRenamed("hash", "theirs")
    return a.join(b, ["level", "prefix"], "full_outer").where(~F.col("mine").eqNullSafe(F.col("theirs")))


def rows_to_send(mine: DataFrame, theirs: DataFrame, differing: DataFrame) -> DataFrame:
    """Rows (key, digest) of mine that theirs lacks or has otherwise, looked for in differing leaves only. One direction: the other side sends its own."""
    spots = differing.where(F.col("level") == DEPTH).select("prefix")
    near = lambda d: d.withColumn("prefix", F.substring("key", 1, DEPTH)).join(spots, "prefix", "left_semi").drop("prefix")
    return digest_diff(near(mine), near(theirs))


def digest_diff(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """Flat comparison: rows (key, digest) of mine without the same row in theirs."""
    return mine.join(theirs, ["key", "digest"], "left_anti")

"""What replicas tell each other, over shared tables: deltas, whole states, and the rules for when which is needed."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hlc
from .lattice import merge_row

# Limits of the protocol.
OFFLINE_MILLIS, CLOCK_GAP_MILLIS = 60_000, 5_000
SAFETY_MILLIS = 30_000
INLINE_BYTES, CHUNK_BYTES = 8 << 20, 1 << 20
CHUNK_EXPIRY_MILLIS = 5 * 60_000
# Kinds of messages.
MESSAGES = """
heartbeat raw_data raw_delta local_file_chunk fetch_raw_request fetch_raw_response version_digest
merkle_root_req merkle_root_ack merkle_node_req merkle_node_ack merkle_leaf_req merkle_leaf_ack
gc_prepare gc_prepare_ack gc_commit gc_commit_ack gc_execute gc_execute_ack gc_abort gc_abort_ack
""".split()
#: A message as a row of a stream.
ENVELOPE = (
    "kind string, tenant string, sender string, request_id string, tbl string, pk string, columns array<string>, payload binary, "
    "file struct<path: string, hash: string, size: bigint, chunk: int, chunks: int>, clock bigint, gc_floor bigint, safe_ts bigint, success boolean, error string"
)


def delta(state: DataFrame, columns: Sequence[str], pks: Sequence[str] | None = None) -> DataFrame:
    """The atoms of some columns (all, if none are named) and rows."""
    out = state.where(F.col("col").isin(list(columns))) if columns else state
    return out.where(F.col("pk").isin(list(pks))) if pks is not None else out


def full_sync(mine: dict[str, DataFrame], theirs: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """State tables by type after taking in all of theirs."""
    return merge_row({k: [d[k] for d in (mine, theirs) if k in d] for k in {*mine, *theirs}})


def safe_timestamp(clocks: DataFrame, local: int) -> DataFrame:
    """One row: the least of the local clock and those of the known peers (clock; 0 is unknown; offline ones count), less the safety margin."""
    known = F.min(F.when(F.col("clock") > 0, F.col("clock")))
    return clocks.agg(hlc.sub_physical(F.least(F.lit(local), F.coalesce(known, F.lit(local))), SAFETY_MILLIS).alias("safe_ts"))


def floor_gate(peer: Column, local: Column) -> Column:
    """What to do about a peer whose garbage was collected up to another point: pass, full_sync and adopt, or block."""
    return F.when(peer == local, "pass").when(peer > local, "full_sync").otherwise("block")


def floor_action(peer: int, local: int) -> str:
    """floor_gate() of two numbers; 0 and less is no floor yet."""
    peer, local = max(peer, 0), max(local, 0)
    return "pass" if peer == local else "full_sync" if peer > local else "block"


def rejoin(offline_millis: Column, clock_lag_millis: Column, offline: int = OFFLINE_MILLIS, gap: int = CLOCK_GAP_MILLIS) -> Column:
    """full_sync after a long absence or with a clock far behind, else clock_update. 0 turns a rule off."""
    far = F.lit(False)
    if offline > 0:
        far |= offline_millis >= offline
    if gap > 0:
        far |= clock_lag_millis > gap
    return F.when(far, "full_sync").otherwise("clock_update")


def heartbeats(beats: DataFrame, now_millis: int, local_clock: int) -> DataFrame:
    """Peers as their last heartbeats (peer, millis, clock, gc_floor) show them, and how each rejoins."""
    last = beats.groupBy("peer").agg(F.max_by(F.struct("millis", "clock", "gc_floor"), F.struct("millis", "clock")).alias("b")).select("peer", "b.*")
    away = F.lit(now_millis) - F.col("millis")
    lag = F.greatest(hlc.physical(F.lit(local_clock)) - hlc.physical(F.col("clock")), F.lit(0))
    return last.withColumns({"online": away < OFFLINE_MILLIS, "rejoin": rejoin(away, lag)})


def chunk_count(size: Column, inline: int = INLINE_BYTES, chunk: int = CHUNK_BYTES) -> Column:
    """In how many messages a file goes: one up to the inline limit, else by chunks."""
    return F.when(size <= inline, F.lit(1)).otherwise(F.greatest(F.lit(1), F.ceil(size / chunk))).cast("long")


def chunk_plan(files: DataFrame, inline: int = INLINE_BYTES, chunk: int = CHUNK_BYTES) -> DataFrame:
    """A row for each chunk of files (path, size, hash): path, chunk (from 0), chunks, offset, length, hash."""
    each = files.withColumn("chunks", chunk_count(F.col("size"), inline, chunk))
    each = each.select("path", "size", "hash", "chunks", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"))
    at = F.col("chunk") * chunk
    length = F.when(F.col("chunks") == 1, F.col("size")).otherwise(F.least(F.lit(chunk).cast("long"), F.col("size") - at))
    return each.select("path", "chunk", "chunks", at.alias("offset"), length.alias("length"), "hash")


def assembled(chunks: DataFrame) -> DataFrame:
    """path and content of files from their chunks (path, chunk, chunks, bytes, size, hash) in any order; a repeated chunk counts once. A file with a chunk
    missing, or whose size or hash is wrong, raises when the result is read. A file's chunks must fit into one value, as its content does."""
    one = chunks.groupBy("path", "chunk").agg(F.min(F.struct("bytes", "chunks", "size", "hash")).alias("c"))
    of = one.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("chunk", "c.bytes"))).alias("parts"), F.min("c.chunks").alias("chunks"), F.min("c.size").alias("size"), F.min("c.hash").alias("hash"))
    content = F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["bytes"])), ""))
    got = of.select("path", "size", "hash", (F.size("parts") == F.col("chunks")).alias("whole"), content.alias("content"))
    sound = F.col("whole") & (F.octet_length("content") == F.col("size")) & (F.sha2("content", 256) == F.col("hash"))
    return got.select("path", F.when(sound, F.col("content")).otherwise(F.raise_error(F.concat(F.lit("broken file "), F.col("path")))).alias("content"))


@dataclass
class _Coming:
    chunks: int
    size: int
    hash: str
    parts: list[bytes] = field(default_factory=list)
    millis: int = 0


@dataclass
class ChunkReceiver:
    """Files that peers send chunk by chunk: in strict order, within `expiry` of the chunk before. What breaks a rule is dropped, and is an error."""

    expiry: int = CHUNK_EXPIRY_MILLIS
    coming: dict[tuple[str, str], _Coming] = field(default_factory=dict)

    def accept(self, peer: str, path: str, chunk: int, chunks: int, data: bytes, sha256: str, size: int, now: int | None = None) -> bytes | None:
        """The whole file after its last chunk, None before."""
        now = time.time_ns() // 1_000_000 if now is None else now
        for k in [k for k, c in self.coming.items() if now - c.millis > self.expiry]:
            del self.coming[k]
        if chunk == 0:
            self.coming[peer, path] = _Coming(chunks, size, sha256)
        c = self.coming.get((peer, path))
        if c is None or chunk != len(c.parts) or (c.chunks, c.size, c.hash) != (chunks, size, sha256) or sum(map(len, c.parts)) + len(data) > size:
            self.coming.pop((peer, path), None)
            raise ValueError(f"chunk {chunk} of {path} doesn't follow, or is of another file")
        c.parts.append(data)
        c.millis = now
        if len(c.parts) < chunks:
            return None
        del self.coming[peer, path]
        whole = b"".join(c.parts)
        if len(whole) != size or hashlib.sha256(whole).hexdigest() != sha256:
            raise ValueError(f"{path} arrived with another size or hash")
        return whole


def messages(sent: DataFrame) -> DataFrame:
    """Rows with some of a message's fields as whole messages; those of an unknown kind raise when the result is read."""
    have = {c.lower() for c in sent.columns}
    empty = sent.sparkSession.createDataFrame([], ENVELOPE)
    out = [(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in empty.schema.fields]
    known = F.col("kind").isin(MESSAGES)
    return sent.select(*out).withColumn("kind", F.when(known, F.col("kind")).otherwise(F.raise_error(F.concat(F.lit("unknown kind "), F.col("kind")))))


def file_metadata(files: DataFrame) -> DataFrame:
    """One row for each path of files (path, hash, size); a path with different contents raises when the result is read."""
    same = (F.min("hash") == F.max("hash")) & (F.min("size") == F.max("size"))
    one = files.groupBy("path").agg(F.min("hash").alias("hash"), F.min("size").alias("size"), same.alias("same"))
    wrong = F.raise_error(F.concat(F.lit("conflicting metadata of "), F.col("path")))
    return one.select(F.when(F.col("same"), F.col("path")).otherwise(wrong).alias("path"), "hash", "size")

"""Keys and byte values in a database: last-write-wins atoms of one table, so that a store merges, is logged and is backed up as any table is."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.schema import TableSchema
from .database import Database

_VALUE, _UNTIL = "value", "until"


class KeyValue:
    """set(), get(), delete() and scan(); several writes are one commit inside `with store.db.update()`."""

    def __init__(self, db: Database, name: str = "_kv") -> None:
        self.db, self.table = db, db.define(TableSchema(name))

    def set(self, key: str, value: bytes, ttl_seconds: int = 0, now_millis: int | None = None) -> None:
        """Writes a value, for so many seconds if more than 0, else for good."""
        until = str(_now(now_millis) + 1000 * ttl_seconds).encode() if ttl_seconds > 0 else None
        self._put(key, value, until)

    def delete(self, key: str) -> None:
        self._put(key, None, None)

    def _put(self, key: str, value: bytes | None, until: bytes | None) -> None:
        with self.db.update():
            ts = self.db.clock.now()
            self.table._add("lww", (key, _VALUE, ts, value), (key, _UNTIL, ts, until))

    def get(self, key: str, now_millis: int | None = None) -> bytes | None:
        """The value; None if there is none, it was deleted, or its time is over. The key's filter reaches the scan."""
        row = self._live(self.table.state("lww", key), now_millis).first()
        return bytes(row["value"]) if row else None

    def scan(self, prefix: str = "", now_millis: int | None = None, desc: bool = False) -> DataFrame:
        """key and value of the keys that begin so, in order."""
        rows = self._live(self.table.state("lww").where(F.col("pk").startswith(prefix)), now_millis)
        return rows.orderBy(F.desc("key") if desc else F.asc("key"))

    @staticmethod
    def _live(state: DataFrame, now_millis: int | None) -> DataFrame:
        own = lambda c: F.max(F.when(F.col("col") == c, F.col("value"))).alias(c)
        until = F.decode(_UNTIL, "utf-8").cast("long")
        rows = state.groupBy(F.col("pk").alias("key")).agg(own(_VALUE), own(_UNTIL))
        return rows.where(F.col(_VALUE).isNotNull() & (F.col(_UNTIL).isNull() | (until > _now(now_millis)))).select("key", "value")


def _now(millis: int | None) -> int:
    return time.time_ns() // 1_000_000 if millis is None else millis

"""Messages between the replicas of a tenant, over shared storage: sent to one or all of them, asked and answered in parts."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sync import ENVELOPE, MESSAGES

#: A message with its place: to whom (null: all but the sender), when, and, of an answer, its number and whether it is the last.
LETTER = f"{ENVELOPE}, receiver string, sent_millis bigint, number bigint, last boolean"


class PartialAnswer(RuntimeError):
    """An answer whose end, or some part of it, didn't come."""


class Mailbox:
    """One node's access to its tenant's folder of messages. Tenants have folders of their own, so that none sees another's."""

    def __init__(self, spark: SparkSession, folder: str, tenant: str, node: str) -> None:
        self.spark, self.tenant, self.node = spark, tenant, node
        self.at = f"{folder.rstrip('/')}/{tenant.encode().hex()}"

    def _post(self, letters: Iterable[Mapping[str, object]]) -> None:
        names = self.spark.createDataFrame([], LETTER).columns
        rows = []
        for x in letters:
            if x["kind"] not in MESSAGES:
                raise ValueError(f"unknown kind {x['kind']}")
            full = {"tenant": self.tenant, "sender": self.node, "sent_millis": time.time_ns() // 1_000_000} | dict(x)
            rows.append(tuple(full.get(n) for n in names))
        self.spark.createDataFrame(rows, LETTER).coalesce(1).write.mode("append").parquet(self.at)

    def send(self, receiver: str, kind: str, **fields: object) -> str:
        """To one node; gives the request's id."""
        request = str(fields.pop("request_id", None) or uuid.uuid4())
        self._post([{"kind": kind, "receiver": receiver, "request_id": request, **fields}])
        return request

    def broadcast(self, kind: str, **fields: object) -> None:
        self._post([{"kind": kind, **fields}])

    def received(self) -> DataFrame:
        """All messages for this node; empty before the first of the tenant."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.at)
        if not path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(path):
            return self.spark.createDataFrame([], LETTER)
        every = self.spark.read.schema(LETTER).parquet(self.at)
        return every.where((F.col("receiver") == self.node) | F.col("receiver").isNull() & (F.col("sender") != self.node))

    def answer(self, request: str, receiver: str, kind: str, parts: Iterable[Mapping[str, object]], ended: bool = True) -> None:
        """An answer in parts, the last marked as such; ended=False: as if the sender went away before it."""
        letters = [{"kind": kind, "receiver": receiver, "request_id": request, "number": i, "last": False, **p} for i, p in enumerate(parts)]
        if ended:
            letters.append({"kind": kind, "receiver": receiver, "request_id": request, "number": len(letters), "last": True})
        self._post(letters)

    def collect(self, request: str, idle_seconds: float = 1.0, pause: float = 0.2) -> DataFrame:
        """The parts of an answer, once its last has come with all before it; PartialAnswer if nothing new comes for idle_seconds before that."""
        seen, since = -1, time.monotonic()
        while True:
            mine = self.received().where(F.col("request_id") == request).where("number is not null")
            told = mine.agg(F.countDistinct("number").alias("n"), F.max(F.when(F.col("last"), F.col("number"))).alias("end")).first()
            if told["end"] is not None and told["n"] == told["end"] + 1:
                return mine.where("not last").dropDuplicates(["number"])
            if told["n"] != seen:
                seen, since = told["n"], time.monotonic()
            elif time.monotonic() - since >= idle_seconds:
                raise PartialAnswer(f"{told['n']} parts of {request}")
            time.sleep(pause)

"""Ordered lists. Every vertex but the first ones names the vertex it was put after; all of one column hang on one virtual head, the empty id."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .lattice import KEYS

HEAD = ""


def linearize(vertices: DataFrame, keys: Sequence[str] = KEYS, head: object = HEAD) -> DataFrame:
    """keys, pos (from 0), id, value, deleted: each list's vertices in order, deleted ones included.

    A vertex comes before what was put after it; of those put after the same one the latest comes first, then the greatest id. What hangs on
    a vertex that isn't there follows at the end by the same rule. Lists are walked one after the other with an explicit stack, as appending
    makes trees as deep as the list is long, which no fixed number of joins reaches; a task holds one list at a time.
    """
    fields = {f.name: f.dataType.simpleString() for f in vertices.schema.fields}
    names = [*keys, "pos", "id", "value", "deleted"]
    schema = ", ".join(f"{c} {fields.get(c, 'bigint')}" for c in names)

    def walk(ids: list, origins: list) -> list[int]:
        """Places in order; ids and origins come by rising ts and id, so that the last one put on a stack comes first."""
        known, children, roots = set(ids), {}, []
        for i, origin in enumerate(origins):
            if origin == head or origin is None:
                children.setdefault(head, []).append(i)
            elif origin in known:
                children.setdefault(origin, []).append(i)
            else:
                roots.append(i)
        order, seen = [], set()
        for start in (children.get(head, []), roots, range(len(ids))):
            stack = list(start)
            while stack:
                i = stack.pop()
                if i not in seen:
                    seen.add(i)
                    order.append(i)
                    stack.extend(children.get(ids[i], ()))
        return order

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def ordered(t: pa.Table) -> Iterator[pa.RecordBatch]:
            keys_of = list(zip(*(t.column(k).to_pylist() for k in keys), strict=True))
            cuts = [0, *(i for i in range(1, len(keys_of)) if keys_of[i] != keys_of[i - 1]), len(keys_of)]
            ids, origins, take, pos = t.column("id").to_pylist(), t.column("origin").to_pylist(), [], []
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                take.extend(s + i for i in walk(ids[s:e], origins[s:e]))
                pos.extend(range(e - s))
            t = t.take(pa.array(take, pa.int64())).append_column("pos", pa.array(pos, pa.int64())).select(names)
            yield from t.combine_chunks().to_batches()

        parts: list[pa.RecordBatch] = []  # of the list that may go on in the next batch
        for batch in batches:
            of = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
            if not of:
                continue
            cut = len(of)
            while cut and of[cut - 1] == of[-1]:
                cut -= 1
            if cut or parts and tuple(parts[0].column(k)[0].as_py() for k in keys) != of[0]:
                done = pa.Table.from_batches([*parts, batch.slice(0, cut)])
                yield from ordered(done.combine_chunks())
                parts = []
            parts.append(batch.slice(cut))
        if parts:
            yield from ordered(pa.Table.from_batches(parts).combine_chunks())

    dealt = vertices.select(*keys, "id", "value", "origin", "ts", "deleted").repartition(*keys).sortWithinPartitions(*keys, "ts", "id")
    return dealt.mapInArrow(run, schema)


def live(linear: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Live vertices with idx, their place among the live ones (from 0)."""
    idx = F.row_number().over(W.partitionBy(*keys).orderBy("pos")) - 1
    return linear.where("not deleted").select(*keys, idx.cast("long").alias("idx"), "id", "value")


def values(linear: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """One array of live values for each list."""
    at = F.array_sort(F.collect_list(F.struct("pos", "value")))
    return linear.where("not deleted").groupBy(*keys).agg(F.transform(at, lambda x: x["value"]).alias("values"))


def _only(df: DataFrame, pk: str, col: str) -> DataFrame:
    return df.where((F.col("pk") == pk) & (F.col("col") == col))


def anchor_of_value(linear: DataFrame, pk: str, col: str, value: bytes) -> str:
    """Id of the first live vertex with this value; LookupError without one."""
    row = _only(linear, pk, col).where(~F.col("deleted") & (F.col("value") == F.lit(value))).orderBy("pos").first()
    if row is None:
        raise LookupError(f"{value!r} is not in {col} of {pk}")
    return row["id"]


def _at(linear: DataFrame, pk: str, col: str, index: int) -> Row:
    row = live(_only(linear, pk, col)).where(F.col("idx") == index).first() if index >= 0 else None
    if row is None:
        raise IndexError(f"{col} of {pk} has no index {index}")
    return row


def anchor_of_index(linear: DataFrame, pk: str, col: str, index: int) -> str:
    """Id to insert after so that the new vertex gets this index: the head for 0; IndexError beyond the end."""
    return HEAD if index == 0 else _at(linear, pk, col, index - 1)["id"]


def vertex_at(linear: DataFrame, pk: str, col: str, index: int) -> str:
    return _at(linear, pk, col, index)["id"]


def tail(linear: DataFrame, pk: str, col: str) -> str:
    """Id of the last vertex, deleted or not; the head of an empty list."""
    row = _only(linear, pk, col).orderBy(F.desc("pos")).first()
    return row["id"] if row else HEAD

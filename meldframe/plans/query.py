"""Typed conjunctive queries on a wide table (a DataFrame with pk and declared columns), built step by step and handed to Catalyst as one plan."""

from __future__ import annotations

import operator
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import literal
from .schema import Index, TableSchema

_COMPARE = {"=": operator.eq, "!=": operator.ne, ">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le}
_RANGES = {">", ">=", "<", "<="}


@dataclass(frozen=True)
class Condition:
    field: str
    op: str
    value: object


@dataclass(frozen=True)
class Plan:
    """The index that fits the conditions best: its columns with equality, in order, then perhaps one with a range."""

    index: Index | None = None
    equal: tuple[str, ...] = ()
    ranged: str | None = None

    @property
    def score(self) -> int:
        return 10 * len(self.equal) + 5 * (self.ranged is not None)


def select_plan(schema: TableSchema, conditions: Sequence[Condition]) -> Plan:
    """Longest run of equalities, then a range, then most columns covered, then first declared. IN and != use no index."""
    equal, ranged = {c.field for c in conditions if c.op == "="}, {c.field for c in conditions if c.op in _RANGES}
    best, rank = Plan(), (0, 0, 0, 0)
    for i in schema.indexes:
        run = 0
        while run < len(i.columns) and i.columns[run] in equal:
            run += 1
        tail = i.columns[run] if run < len(i.columns) and i.columns[run] in ranged else None
        plan = Plan(i, i.columns[:run], tail)
        own = (plan.score, run, int(tail is not None), sum(c in equal | ranged for c in i.columns))
        if plan.score and own > rank:
            best, rank = plan, own
    return best


def shortlex(c: SparkColumn) -> list[SparkColumn]:
    """Order of strings and bytes in an index: by length, then content."""
    return [F.octet_length(c), c]


@dataclass(frozen=True)
class Query:
    """where().and_().order_by().offset().limit().find(). Each step gives a new query; a literal that isn't of the column's type is
    reported by find().

    order: "column" sorts by the order_by column and then pk; "index" by the chosen index's columns (strings by length first) and then pk,
    or by pk alone without one, and desc turns the whole order round.
    """

    table: DataFrame
    schema: TableSchema
    conditions: tuple[Condition, ...] = ()
    error: ValueError | None = None
    skip: int = 0
    most: int = 0
    by: str | None = None
    desc: bool = False
    order: str = "column"

    def where(self, field: str, op: str, value: object) -> Query:
        try:
            return replace(self, conditions=(*self.conditions, self._condition(field, op, value)))
        except ValueError as e:
            return self if self.error else replace(self, error=e)

    and_ = where

    def _condition(self, field: str, op: str, value: object) -> Condition:
        if field not in (c.name for c in self.schema.columns):
            return Condition(field, op, value)  # no row has it
        column = self.schema.column(field)
        if column.crdt not in ("lww", "counter"):
            raise ValueError(f"{field} is a {column.crdt} column and can't be compared; sets have contains()")
        kind = "int" if column.crdt == "counter" else column.type
        if op == "IN":
            if not isinstance(value, list | tuple):
                raise ValueError("normalize condition: IN needs a list")
            return Condition(field, op, tuple(literal(v, kind) for v in value))
        if op not in _COMPARE:
            raise ValueError(f"unknown operator {op}")
        return Condition(field, op, literal(value, kind))

    def contains(self, field: str, elem: object) -> Query:
        """Rows whose set column (an array here) has the element."""
        return replace(self, conditions=(*self.conditions, Condition(field, "contains", elem)))

    def offset(self, n: int) -> Query:
        return replace(self, skip=n)

    def limit(self, n: int) -> Query:
        """0 and less: all rows."""
        return replace(self, most=n)

    def order_by(self, field: str | None, desc: bool = False) -> Query:
        return replace(self, by=field, desc=desc)

    def ordered(self, mode: str) -> Query:
        return replace(self, order=mode)

    def plan(self) -> Plan:
        return select_plan(self.schema, self.conditions)

    def _test(self, c: Condition) -> SparkColumn:
        if c.field not in self.table.columns:
            return F.lit(False)
        if c.op == "contains":
            return F.array_contains(c.field, c.value)
        if c.op == "IN":
            return F.col(c.field).isin(list(c.value)) if c.value else F.lit(False)
        return _COMPARE[c.op](F.col(c.field), F.lit(c.value))

    def _sort(self) -> list[SparkColumn]:
        turn = (lambda c: c.desc()) if self.desc else (lambda c: c.asc())
        if self.order == "column":
            return [*([turn(F.col(self.by))] if self.by else []), turn(F.col("pk")) if not self.by else F.col("pk").asc()]
        keys: list[SparkColumn] = []
        if (plan := self.plan()).index:
            for c in plan.index.columns:
                kind = self.schema.column(c).type
                keys += shortlex(F.col(c)) if kind in ("string", "bytes") else [F.col(c)]
        return [turn(k) for k in (*keys, F.col("pk"))]

    def find(self) -> DataFrame:
        """The rows, pk included. With an offset or a limit they are the first of the order; a limit alone needs no full sort."""
        if self.error:
            raise self.error
        out = self.table
        for c in self.conditions:
            out = out.where(self._test(c))
        if self.skip > 0 or self.most > 0 or self.by or self.desc:
            out = out.orderBy(*self._sort())
        out = out.offset(self.skip) if self.skip > 0 else out
        return out.limit(self.most) if self.most > 0 else out

    def find_states(self, *states: DataFrame) -> list[DataFrame]:
        """The atoms of the rows found, from state tables by pk."""
        found = self.find().select("pk")
        return [s.join(found, "pk", "left_semi") for s in states]


def index_entries(wide: DataFrame, schema: TableSchema, index: Index) -> DataFrame:
    """An index's columns and pk, of the rows that have all of them, in the index's order: strings and bytes by length first, then pk."""
    keys: list[SparkColumn] = []
    for c in index.columns:
        keys += shortlex(F.col(c)) if schema.column(c).type in ("string", "bytes") else [F.col(c)]
    return wide.select(*index.columns, "pk").dropna(subset=list(index.columns)).orderBy(*keys, "pk")

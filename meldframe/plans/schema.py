"""Table schemas: declared, checked, and kept as JSON beside the tables."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from ..functions.coerce import ELEMENTS, SPARK_TYPES

# The types of columns by how replicas are merged.
MERGE_TYPES = ["lww", "counter", "orset", "rga", "file"]


@dataclass(frozen=True)
class Column:
    name: str
    type: str = "string"
    crdt: str = "lww"


@dataclass(frozen=True)
class Index:
    """An order of columns. `unique` is kept and compared, and enforced by nothing."""

    name: str
    columns: tuple[str, ...]
    unique: bool = False
    id: int = 0


@dataclass(frozen=True)
class TableSchema:
    name: str
    columns: tuple[Column, ...] = ()
    indexes: tuple[Index, ...] = ()
    id: int = 0

    def column(self, name: str) -> Column:
        for c in self.columns:
            if c.name == name:
                return c
        raise KeyError(name)

    def same(self, other: TableSchema) -> bool:
        """Whether both declare the same; ids and the order of declarations don't matter, that of an index's columns does."""
        key = lambda t: (t.name, frozenset(t.columns), frozenset((i.name, i.columns, i.unique) for i in t.indexes))
        return key(self) == key(other)


def _names(kind: str, names: list[str]) -> list[str]:
    names = [n.strip() for n in names]
    if not all(names):
        raise ValueError(f"a {kind} needs a name")
    if len(set(names)) < len(names):
        raise ValueError(f"a {kind} name occurs twice in {names}")
    return names


def checked(t: TableSchema) -> TableSchema:
    """The schema with trimmed names, empty types filled in and index ids in the gaps; ValueError if it can't be."""
    (name,) = _names("table", [t.name])
    columns = []
    for c, n in zip(t.columns, _names("column", [c.name for c in t.columns]), strict=True):
        kind, crdt = c.type.strip() or "string", c.crdt.strip() or "lww"
        if kind not in SPARK_TYPES and not (kind in ELEMENTS and crdt in ("orset", "rga")):
            raise ValueError(f"column {n}: {kind} is not one of {', '.join(SPARK_TYPES)}")
        if crdt not in MERGE_TYPES:
            raise ValueError(f"column {n}: {crdt} is not one of {', '.join(MERGE_TYPES)}")
        columns.append(Column(n, kind, crdt))
    of = {c.name: c.crdt for c in columns}
    used = [i.id for i in t.indexes if i.id]
    if len(set(used)) < len(used):
        raise ValueError("an index id occurs twice")
    free = (i for i in range(1, len(t.indexes) + len(used) + 1) if i not in used)
    indexes = []
    for i, n in zip(t.indexes, _names("index", [i.name for i in t.indexes]), strict=True):
        on = tuple(c.strip() for c in i.columns)
        if not on or not all(on):
            raise ValueError(f"index {n} needs columns with names")
        if bad := [c for c in on if of.get(c) in ("orset", "rga", "file")]:
            raise ValueError(f"index {n}: {bad[0]} has no order")
        indexes.append(Index(n, on, i.unique, i.id or next(free)))
    return TableSchema(name, tuple(columns), tuple(indexes), t.id)


@dataclass
class Catalog:
    """The schemas of one database."""

    tables: dict[str, TableSchema] = field(default_factory=dict)

    def add(self, t: TableSchema) -> TableSchema:
        """Declares a table. Again in the same way, nothing happens; in another way is an error."""
        t = checked(t)
        if old := self.tables.get(t.name):
            if not old.same(t):
                raise ValueError(f"table {t.name} is declared otherwise")
            return old
        ids = {x.id for x in self.tables.values()}
        if t.id in ids:
            raise ValueError(f"table id {t.id} is taken")
        self.tables[t.name] = t = TableSchema(t.name, t.columns, t.indexes, t.id or max(ids, default=0) + 1)
        return t

    def get(self, name: str) -> TableSchema:
        return self.tables[name]

    def by_id(self, number: int) -> TableSchema:
        return next(t for t in self.tables.values() if t.id == number)

    def names(self) -> list[str]:
        return sorted(self.tables)

    def to_json(self) -> str:
        return json.dumps([asdict(self.tables[n]) for n in self.names()])

    @staticmethod
    def from_json(text: str) -> Catalog:
        out = Catalog()
        for t in json.loads(text):
            if t["name"].strip() in out.tables:
                raise ValueError(f"table {t['name']} occurs twice")
            out.add(TableSchema(t["name"], tuple(Column(**c) for c in t["columns"]), tuple(Index(i["name"], tuple(i["columns"]), i["unique"], i["id"]) for i in t["indexes"]), t["id"]))
        return out

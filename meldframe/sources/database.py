"""Databases of replicated tables in a folder: state tables as lists of immutable Parquet segments, named by one pointer file.

A commit appends segments of what was written, whatever the size of the state; reads merge the segments of a kind, which changes nothing but
repeats. Once a level has `FAN` segments they become one of the next level, sorted by pk, so that an atom is rewritten a few times in all, and
so that a read of one row skips row groups by their bounds. The same commits go to a log, which streaming.feed reads.
"""

from __future__ import annotations

import contextlib
import json
import re
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions.coerce import ELEMENTS, literal, loaded
from ..functions.hlc import Clock
from ..operators import digest, gc, lattice, rga, sync
from ..plans.query import Query, index_entries
from ..plans.schema import Catalog, TableSchema
from ..plans.schema import Column as SchemaColumn
from ..streaming.feed import OPLOG
from .files import Import, checked_path
from .folder import Folder

_PK = re.compile(r"[0-9a-f]{8}-[0-9a-f]{4}-7[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}")
#: Segments of a level that are merged into one of the next.
FAN = 16


def checked_pk(pk: str) -> str:
    if not _PK.fullmatch(pk):
        raise ValueError(f"{pk!r} is no version 7 UUID")
    return pk


def stored_bytes(value: object, kind: str) -> bytes:
    """A literal as its column stores it."""
    if kind in ELEMENTS:
        return ELEMENTS[kind].to_bytes(value)
    v = literal(value, kind)
    if kind == "bytes":
        return v
    if kind == "bool":
        return b"true" if v else b"false"
    if kind == "float":
        return re.sub(r"\.0$", "", repr(v)).encode()
    if kind == "timestamp":
        text = v.strftime("%Y-%m-%dT%H:%M:%S") + (f".{v.microsecond:06d}".rstrip("0") if v.microsecond else "")
        return f"{text}Z".encode()
    return str(v).encode()


@dataclass(frozen=True)
class FileImport:
    local: str
    relative: str


@dataclass(frozen=True)
class Atoms:
    """A value as atoms of its lattice, such as another row's: set() stores them as they are. Rows have the state's columns after pk and col."""

    kind: str
    rows: tuple[tuple, ...]


class FloorMismatch(ValueError):
    """A peer whose garbage was collected up to another point: its atoms may bring back what is gone here, or the other way round."""


class RowView:
    """The columns of one row, by type. What is missing or of another type is None, or empty."""

    def __init__(self, pk: str, values: dict[str, object]) -> None:
        self.pk, self.values = pk, values

    def has(self, column: str) -> bool:
        return self.values.get(column) is not None

    def get(self, column: str) -> object:
        return self.values.get(column)

    def _of(self, column: str, *types: type) -> object:
        v = self.values.get(column)
        return v if isinstance(v, types) and not (isinstance(v, bool) and bool not in types) else None

    def get_string(self, column: str) -> str | None:
        return self._of(column, str)

    def get_int(self, column: str) -> int | None:
        return self._of(column, int)

    def get_list(self, column: str) -> list:
        """The live values of a list in order, or the elements of a set."""
        return list(self._of(column, list) or [])

    def contains(self, column: str, element: object) -> bool:
        return element in self.get_list(column)

    def get_file(self, column: str) -> dict | None:
        """path, hash and size."""
        return self._of(column, dict)


class Table:
    """Reads and writes of one table. Writes are atoms; a commit appends those it has."""

    def __init__(self, db: Database, schema: TableSchema) -> None:
        self.db, self.schema, self.spark = db, schema, db.spark
        self.pending: dict[str, list[tuple]] = {}

    def atoms(self, kind: str, pk: str | None = None) -> tuple[DataFrame, bool]:
        """Atoms of a kind as they were written, of one row if named, those of the open transaction included; and whether some may be there twice."""
        out, whole = self.db._read(self.schema.name, kind)
        out = out if pk is None else out.where(F.col("pk") == pk)
        own = [a for a in self.pending.get(kind, ()) if pk in (None, a[0])]
        if own:
            out = out.unionByName(self.spark.createDataFrame(own, lattice.STATES[kind]))
        return out, bool(own) or not whole

    def state(self, kind: str, pk: str | None = None) -> DataFrame:
        """Merged atoms of a kind, of one row if named: its filter reaches the scan."""
        out, several = self.atoms(kind, pk)
        if kind == "orset":
            return lattice.merge_orset(out, self.atoms("tombstone", pk)[0])
        return lattice.MERGES[kind](out) if several else out

    def wide(self, pk: str | None = None) -> DataFrame:
        """A row for each pk, or the one, with all declared columns as their types."""
        of = {k: [c for c in self.schema.columns if c.crdt == k] for k in ("lww", "counter", "orset", "rga", "file")}
        parts = []
        if of["lww"]:
            parts.append(lattice.wide_lww(self.state("lww", pk), {c.name: c.type for c in of["lww"]}))
        own = lambda c, v: F.when(F.col("col") == c.name, v)
        if of["counter"]:
            parts.append(lattice.counter_value(self.state("counter", pk)).groupBy("pk").agg(*(F.max(own(c, F.col("value"))).alias(c.name) for c in of["counter"])))
        if of["orset"]:
            live = lattice.orset_elements(self.state("orset", pk)).groupBy("pk")
            sets = [F.sort_array(F.collect_set(own(c, loaded(F.col("elem"), c.type)))).alias(c.name) for c in of["orset"]]
            parts.append(live.agg(*sets).select("pk", *(F.when(F.size(c.name) > 0, F.col(c.name)).alias(c.name) for c in of["orset"])))
        if of["rga"]:
            lists = rga.values(rga.linearize(self.state("rga", pk))).groupBy("pk")
            typed = lambda kind: F.transform("values", lambda v: loaded(v, kind))
            parts.append(lists.agg(*(F.first(own(c, typed(c.type)), True).alias(c.name) for c in of["rga"])))
        if of["file"]:
            parts.append(self.state("file", pk).groupBy("pk").agg(*(F.first(own(c, F.struct("path", "hash", "size")), True).alias(c.name) for c in of["file"])))
        out = self.pks(pk)
        for p in parts:
            out = out.join(p, "pk", "left")
        return out

    def pks(self, pk: str | None = None) -> DataFrame:
        return lattice.union([(self.state(k, pk) if k == "orset" else self.atoms(k, pk)[0]).select("pk") for k in ("lww", "counter", "orset", "rga", "file")]).distinct()

    # reads

    def row(self, pk: str) -> RowView:
        """The row, undeclared columns as strings; KeyError if there is none. Each kind's scan has the filter on pk."""
        row = self.wide(checked_pk(pk)).first()
        if row is None:
            raise KeyError(pk)
        names = {c.name for c in self.schema.columns}
        more = self.state("lww", pk).where(~F.col("col").isin(list(names))) if names else self.state("lww", pk)
        extra = {r["col"]: r["value"] for r in more.select("col", F.decode("value", "utf-8").alias("value")).collect()}
        return RowView(pk, {k: v for k, v in (extra | row.asDict(True)).items() if k != "pk" and v is not None})

    def get(self, pk: str) -> dict:
        return self.row(pk).values

    def get_states(self, pk: str) -> dict[str, DataFrame]:
        """The row's atoms by kind; empty tables if there is none."""
        return {k: self.state(k, pk) for k in lattice.STATES}

    def scan(self, desc: bool = False) -> DataFrame:
        return self.wide().orderBy(F.desc("pk") if desc else F.asc("pk"))

    def query(self) -> Query:
        return Query(self.wide(), self.schema)

    def where(self, field: str, op: str, value: object) -> Query:
        return self.query().where(field, op, value)

    def find_states(self, query: Query) -> dict[str, DataFrame]:
        """The atoms of the rows that a query finds, by kind, unread until they are asked for."""
        return dict(zip(lattice.STATES, query.find_states(*(self.state(k) for k in lattice.STATES)), strict=True))

    def raw_rows(self) -> DataFrame:
        """Every atom of the table: pk, col, kind and the atom as JSON (bytes in base 64)."""
        return lattice.union([self._json(k, self.state(k)) for k in lattice.STATES])

    def _json(self, kind: str, state: DataFrame) -> DataFrame:
        fields = [F.base64(c).alias(c) if t == "binary" else F.col(c) for c, t in state.dtypes if c not in ("pk", "col")]
        return state.select("pk", "col", F.lit(kind).alias("kind"), F.to_json(F.struct(*fields)).alias("atom"))

    def raw(self, pk: str, columns: Sequence[str] = ()) -> dict[str, DataFrame]:
        """The row's atoms, of some columns if named; KeyError if there are none."""
        out = {k: d.where(F.col("col").isin(list(columns))) if columns else d for k, d in self.get_states(pk).items()}
        if lattice.union([d.select("pk") for d in out.values()]).isEmpty():
            raise KeyError(pk)
        return out

    def digests(self) -> DataFrame:
        """pk and SHA-256 of each row's canonical atoms."""
        return digest.row_digests(self.raw_rows().where("kind <> 'tombstone'"), ["kind", "col", "atom"])

    def merkle(self, hashed: bool = True) -> DataFrame:
        """The Merkle tree of the rows. hashed: leaves by a hash of the key, as the first digits of keys made at one time are the same."""
        key = F.regexp_replace("pk", "-", "")
        return digest.tree(self.digests().select((F.concat(F.md5(key), key) if hashed else key).alias("key"), "digest"))

    def index(self, name: str) -> DataFrame:
        """An index's rows in its order: from the copy that reindex() wrote if nothing was written since, else from the table."""
        spec = next(i for i in self.schema.indexes if i.name == name)
        at = self.db.meta.get("index", {}).get(f"{self.schema.name}/{name}")
        if at and at["of"] == self.db._version(self.schema.name) and not any(self.pending.values()):
            return self.spark.read.parquet(self.db.folder.at(at["path"]))
        return index_entries(self.wide(), self.schema, spec)

    def reindex(self) -> None:
        """Writes each index as a table of its columns and pk, ranged and sorted in its order, so that ranges of it are read alone."""
        out = {}
        for i in self.schema.indexes:
            path = f"index/{self.schema.name}/{i.name}-{uuid.uuid4().hex}"
            rows = index_entries(self.wide(), self.schema, i)
            rows.repartitionByRange(*i.columns, "pk").sortWithinPartitions(*i.columns, "pk").write.parquet(self.db.folder.at(path))
            out[f"{self.schema.name}/{i.name}"] = {"path": path, "of": self.db._version(self.schema.name)}
        self.db._save(index=self.db.meta.get("index", {}) | out)

    # writes

    def _add(self, kind: str, *atoms: tuple) -> None:
        self.pending.setdefault(kind, []).extend(atoms)
        if not self.db.depth:
            self.db._commit()

    def _linear(self, pk: str, col: str) -> DataFrame:
        return rga.linearize(self.state("rga", pk).where(F.col("col") == col))

    def _column(self, name: str) -> SchemaColumn:
        return next((c for c in self.schema.columns if c.name == name), SchemaColumn(name))

    def set(self, pk: str, values: dict[str, object]) -> None:
        """Writes columns. A counter moves to the value by a delta, sets and lists lose what they show and get the one element (None: none).
        Atoms are stored as they are."""
        checked_pk(pk)
        with self.db.update():
            for name, value in values.items():
                c = self._column(name)
                if isinstance(value, Atoms):
                    if value.kind != c.crdt and (value.kind, c.crdt) != ("tombstone", "orset"):
                        raise ValueError(f"{name} is a {c.crdt} column, not {value.kind}")
                    self._add(value.kind, *((pk, name, *a) for a in value.rows))
                elif c.crdt == "lww":
                    self._add("lww", (pk, name, self.db.clock.now(), stored_bytes(value, c.type)))
                elif c.crdt == "counter":
                    to = value if isinstance(value, int) and not isinstance(value, bool) else int(value) if isinstance(value, float) and value.is_integer() else None
                    if to is None:
                        raise ValueError(f"{name}: a counter takes whole numbers")
                    now = lattice.counter_value(self.state("counter", pk)).where(F.col("col") == name).first()
                    self._count(pk, name, to - (now["value"] if now else 0))
                elif c.crdt == "file":
                    if not isinstance(value, FileImport):
                        raise ValueError(f"{name}: a file column takes a FileImport")
                    file = Import(self.db.folder.sub("files"), value.local, checked_path(value.relative))
                    self.db.undo.append(file.promote())
                    self.db.done.append(file.forget)
                    self._add("file", (pk, name, self.db.clock.now(), file.path, file.hash, file.size))
                else:
                    self._clear(pk, name, c.crdt)
                    if value is not None:
                        self.add(pk, name, value)

    def _clear(self, pk: str, col: str, kind: str) -> None:
        here = self.state(kind, pk).where(F.col("col") == col)
        if kind == "orset":
            self._add("tombstone", *((pk, col, r["tag"], self.db.clock.now()) for r in here.select("tag").toLocalIterator()))
        else:
            self._delete(here.where("not deleted"))

    def _count(self, pk: str, col: str, by: int) -> None:
        mine = self.state("counter", pk).where((F.col("col") == col) & (F.col("node") == self.db.replica)).first()
        inc, dec = (mine["inc"], mine["dec"]) if mine else (0, 0)
        self._add("counter", (pk, col, self.db.replica, inc + max(by, 0), dec + max(-by, 0)))

    def _delete(self, vertices: DataFrame) -> None:
        self._add("rga", *((r["pk"], r["col"], r["id"], r["value"], r["origin"], r["ts"], True, self.db.clock.now()) for r in vertices.toLocalIterator()))

    def add(self, pk: str, col: str, value: object) -> None:
        """Counts up, adds an element with a tag of its own, or appends; a register is set."""
        checked_pk(pk)
        c = self._column(col)
        with self.db.update():
            if c.crdt == "counter":
                if not isinstance(value, int) or isinstance(value, bool):
                    raise ValueError("a counter counts by whole numbers")
                self._count(pk, col, value)
            elif c.crdt == "orset":
                self._add("orset", (pk, col, stored_bytes(value, c.type), f"{self.db.clock.now()}-{uuid.uuid4()}"))
            elif c.crdt == "rga":
                self._insert(pk, col, value, rga.tail(self._linear(pk, col), pk, col))
            else:
                self.set(pk, {col: value})

    def remove(self, pk: str, col: str, value: object) -> None:
        """Counts down, removes the tags seen of an element, or all vertices with a value."""
        checked_pk(pk)
        c = self._column(col)
        with self.db.update():
            if c.crdt == "counter":
                self.add(pk, col, -value)
            elif c.crdt in ("orset", "rga"):
                which = F.lit(stored_bytes(value, c.type))
                here = self.state(c.crdt, pk).where(F.col("col") == col)
                if c.crdt == "orset":
                    self._add("tombstone", *((pk, col, r["tag"], self.db.clock.now()) for r in here.where(F.col("elem") == which).toLocalIterator()))
                else:
                    self._delete(here.where(~F.col("deleted") & (F.col("value") == which)))
            else:
                raise ValueError(f"nothing can be removed from a {c.crdt} column")

    def _insert(self, pk: str, col: str, value: object, origin: str) -> None:
        ts = self.db.clock.now()
        self._add("rga", (pk, col, f"{ts:020d}-{self.db.replica}", stored_bytes(value, self._column(col).type), origin, ts, False, 0))

    def insert_after(self, pk: str, col: str, anchor: object, value: object) -> None:
        kind = self._column(col).type
        with self.db.update():
            self._insert(checked_pk(pk), col, value, rga.anchor_of_value(self._linear(pk, col), pk, col, stored_bytes(anchor, kind)))

    def insert_at(self, pk: str, col: str, index: int, value: object) -> None:
        with self.db.update():
            self._insert(checked_pk(pk), col, value, rga.anchor_of_index(self._linear(pk, col), pk, col, index))

    def remove_at(self, pk: str, col: str, index: int) -> None:
        with self.db.update():
            found = rga.vertex_at(self._linear(checked_pk(pk), col), pk, col, index)
            self._delete(self.state("rga", pk).where((F.col("col") == col) & (F.col("id") == found)))

    def merge(self, states: dict[str, DataFrame], peer: str = "peer", peer_floor: int | None = None, full: bool = False) -> None:
        """Takes in atoms of another replica, whole rows or some columns: appends them, moves the clock beyond them, and logs the cells as seen from peer.

        With a peer_floor other than this database's the merge is blocked (FloorMismatch), unless the peer is ahead and these are its full
        states: then they are taken and its floor is adopted. A column must have the kind its schema declares, and one kind in all it gets.
        """
        action = "pass" if peer_floor is None else sync.floor_action(peer_floor, self.db.gc_floor)
        if action == "block" or action == "full_sync" and not full:
            raise FloorMismatch(f"the peer's floor is {peer_floor}, this one's {self.db.gc_floor}")
        added = {(self.schema.name, k): self.db._segment(self.schema.name, k, 0, d.select(*(f.split()[0] for f in lattice.STATES[k].split(", "))), False) for k, d in states.items()}
        try:
            latest = self._checked(added)
        except BaseException:
            for path in added.values():
                self.db.folder.remove(path)
            raise
        if latest:
            self.db.clock.update(latest)
        self.db._append(added, peer=peer, floor=peer_floor if action == "full_sync" else None)

    def _checked(self, added: dict[tuple[str, str], str]) -> int:
        """The latest timestamp in new segments, which are read as they were written; ValueError if a column in them has another kind than its own."""
        declared = F.create_map(*(F.lit(x) for c in self.schema.columns for x in (c.name, c.crdt))) if self.schema.columns else F.create_map().cast("map<string,string>")
        facts = []
        for (_, kind), path in added.items():
            d = self.db._parquet(kind, path)
            times = [F.col(c) for c in ("ts", "deleted_at") if c in d.columns]
            crdt = "orset" if kind == "tombstone" else kind
            other = F.coalesce(declared[F.col("col")], F.lit("lww")) != crdt
            facts.append(d.agg(F.max(F.greatest(*times, F.lit(0)) if times else F.lit(0).cast("long")).alias("ts"), F.min(F.when(other, F.struct("pk", "col", F.lit(crdt).alias("kind")))).alias("wrong")))
        told = lattice.union(facts).agg(F.max("ts").alias("ts"), F.min("wrong").alias("wrong")).first()
        if told["wrong"]:
            raise ValueError(f"columns of two types: {told['wrong']}")
        return told["ts"] or 0


class Database:
    """A folder with a pointer file, segments of state tables, a log, and files. One writer at a time; readers keep the version they began with."""

    def __init__(self, spark: SparkSession, folder: str, tenant: str = "default") -> None:
        self.spark, self.folder = spark, Folder(spark, folder)
        self.folder.make()
        self.meta = json.loads(self.folder.read_text("meta.json")) if self.folder.exists("meta.json") else {}
        if self.meta.setdefault("tenant", tenant) != tenant:
            raise ValueError(f"this database belongs to {self.meta['tenant']}")
        self.replica = self.meta.setdefault("replica", f"node-{uuid.uuid4()}")
        self.catalog = Catalog.from_json(json.dumps(self.meta.get("tables", [])))
        self.clock = Clock(start=self.meta.get("clock", 0))
        self.tables: dict[str, Table] = {}
        self.depth, self.undo, self.done = 0, [], []
        self.listeners: list[Callable[[DataFrame], None]] = []
        self._save()

    @classmethod
    def open(cls, spark: SparkSession, folder: str, tenant: str = "default", schemas: Sequence[TableSchema] = (), ensure=None) -> Database:
        """Opens or makes a database, declares tables, and calls ensure(database)."""
        db = cls(spark, folder, tenant)
        for s in schemas:
            db.define(s)
        if ensure:
            ensure(db)
        return db

    def _save(self, **more: object) -> None:
        """Replaces the pointer file in one step; until then readers see the version before."""
        self.meta = self.meta | more
        self.folder.write_text("meta.json", json.dumps(self.meta))

    def define(self, schema: TableSchema) -> Table:
        self.catalog.add(schema)
        self._save(tables=json.loads(self.catalog.to_json()))
        return self.table(schema.name.strip())

    def table(self, name: str) -> Table:
        if name not in self.tables:
            self.tables[name] = Table(self, self.catalog.get(name))
        return self.tables[name]

    @property
    def sequence(self) -> int:
        """The number of the last commit."""
        return self.meta.get("sequence", 0)

    @property
    def gc_floor(self) -> int:
        return self.meta.get("gc_floor", 0)

    def _version(self, table: str) -> dict[str, list[str]]:
        return {k: v for k, v in self.meta.get("state", {}).items() if k.split("/")[0] == table}

    def _read(self, table: str, kind: str) -> tuple[DataFrame, bool]:
        """All segments of a kind, and whether they are merged: a commit's own segment may have an atom twice."""
        parts = self.meta.get("state", {}).get(f"{table}/{kind}", [])
        if not parts:
            return self.spark.createDataFrame([], lattice.STATES[kind]), True
        return self._parquet(kind, *parts), len(parts) == 1 and _level(parts[0]) > 0

    def _segment(self, table: str, kind: str, level: int, df: DataFrame, small: bool) -> str:
        """Writes a segment, sorted by pk and col; ranged by pk unless it is small."""
        path = f"state/{table}/{kind}-{level}-{uuid.uuid4().hex}"
        (df.coalesce(1) if small else df.repartitionByRange("pk")).sortWithinPartitions("pk", "col").write.parquet(self.folder.at(path))
        return path

    def _parquet(self, kind: str, *paths: str) -> DataFrame:
        return self.spark.read.schema(lattice.STATES[kind]).parquet(*(self.folder.at(p) for p in paths))

    def _append(self, added: dict[tuple[str, str], str], peer: str | None = None, floor: int | None = None) -> None:
        """Commits segments that were written, by table and kind."""
        state = {k: list(v) for k, v in self.meta.get("state", {}).items()}
        for (table, kind), path in added.items():
            parts = state.setdefault(f"{table}/{kind}", [])
            parts.append(path)
            self._tier(table, kind, parts)
        more = {"gc_floor": gc.raised_floor(self.gc_floor, floor)} if floor else {}
        self._save(state=state, clock=self.clock.now(), sequence=self.sequence + 1, **more)
        self._log(added, peer)

    def _tier(self, table: str, kind: str, parts: list[str]) -> None:
        """Makes one segment of the next level of each FAN of a level."""
        level = 0
        while len(own := [p for p in parts if _level(p) == level]) >= FAN:
            df = self._parquet(kind, *own)
            parts[:] = [p for p in parts if p not in own] + [self._segment(table, kind, level + 1, lattice.MERGES[kind](df) if kind in lattice.MERGES else df.distinct(), False)]
            level += 1

    def _log(self, added: dict[tuple[str, str], str], peer: str | None) -> None:
        """Appends a commit to the log, after it: all atoms of own writes; of a peer's only which cells they are of."""
        names = [x.split()[0] for x in OPLOG.split(", ")]
        parts = []
        for (table, kind), path in added.items():
            df = self._parquet(kind, path)
            have = {"seq": F.lit(self.sequence).cast("long"), "tbl": F.lit(table), "kind": F.lit(kind), "source": F.lit(peer or self.replica), "pk": F.col("pk"), "col": F.col("col")}
            if peer is None:
                have |= {c: F.col(c) for c in df.columns}
            types = {x.split()[0]: x.split()[1] for x in OPLOG.split(", ")}
            cells = df.select(*(have.get(n, F.lit(None)).cast(types[n]).alias(n) for n in names))
            parts.append(cells if peer is None else cells.distinct())
        if parts:
            log = lattice.union(parts)
            (log.coalesce(1) if peer is None else log).write.mode("append").parquet(self.folder.at("log"))
            for listen in self.listeners:
                listen(log)

    def log(self) -> DataFrame:
        """The log as a table; streaming.feed.read_log() has it as a stream."""
        if not self.folder.exists("log"):
            return self.spark.createDataFrame([], OPLOG)
        return self.spark.read.schema(OPLOG).parquet(self.folder.at("log")).where(F.col("seq") <= self.sequence)

    @contextlib.contextmanager
    def update(self) -> Iterator[None]:
        """A transaction: all that is written within is committed at once, or, after an exception, not at all and its files are put back."""
        self.depth += 1
        try:
            yield
        except BaseException:
            if self.depth == 1:
                self._rollback()
            raise
        else:
            if self.depth == 1:
                self._commit()
        finally:
            self.depth -= 1

    def _rollback(self) -> None:
        for t in self.tables.values():
            t.pending = {}
        for undo in reversed(self.undo):
            undo()
        self.undo, self.done = [], []

    def _commit(self) -> None:
        rows = {(t.schema.name, k): v for t in self.tables.values() for k, v in t.pending.items() if v}
        if rows:
            self._append({(name, k): self._segment(name, k, 0, self.spark.createDataFrame(v, lattice.STATES[k]), True) for (name, k), v in rows.items()})
        for t in self.tables.values():
            t.pending = {}
        for done in self.done:
            done()
        self.undo, self.done = [], []

    def compact(self) -> None:
        """Makes one merged segment of each state table, and deletes those that no version names any more: no reader of an older one may be left."""
        state = {}
        for key, parts in self.meta.get("state", {}).items():
            table, kind = key.split("/")
            df = self._read(table, kind)[0]
            if kind == "orset":
                df = lattice.merge_orset(df, self._read(table, "tombstone")[0])
            state[key] = [self._segment(table, kind, 9, lattice.MERGES[kind](df) if kind in lattice.MERGES else df, False)]
        self._save(state=state)
        kept = {p for parts in state.values() for p in parts}
        for table in self.folder.names("state"):
            for name in self.folder.names(f"state/{table}"):
                if f"state/{table}/{name}" not in kept:
                    self.folder.remove(f"state/{table}/{name}")

    def gc(self, safe_ts: int) -> dict[str, int]:
        """Collects garbage in all tables of the catalog and raises the floor. Returns the atoms that went, by kind."""
        total: dict[str, int] = {}
        state = dict(self.meta.get("state", {}))
        for name in self.catalog.names():
            before = {k: self._read(name, k)[0] for k in ("orset", "tombstone", "rga")}
            before["tombstone"], before["rga"] = lattice.merge_tombstones(before["tombstone"]), lattice.merge_rga(before["rga"])
            before["orset"] = before["orset"].distinct()
            after = gc.collect(before, safe_ts)
            for k, n in gc.removed(before, after).items():
                total[k] = total.get(k, 0) + n
                if n:
                    state[f"{name}/{k}"] = [self._segment(name, k, 9, after[k], False)]
        self._save(state=state, clock=self.clock.now(), gc_floor=gc.raised_floor(self.gc_floor, safe_ts))
        return total

    def member(self, peers: Callable[[], DataFrame]) -> gc.Member:
        """This database's side of a collection that all agree on; peers() gives their clocks (clock)."""
        safe = lambda: sync.safe_timestamp(peers(), self.clock.now()).first()["safe_ts"]
        return gc.Member(safe, self.gc, self.gc_floor)

    def backup(self, to: str, since: dict[str, list[str]] | None = None) -> dict[str, list[str]]:
        """Copies the current version, or only segments that a backup whose result is given didn't have; the copy appears at once or not at all.
        Segments are copied by the executors."""
        target = Folder(self.spark, to)
        if target.exists():
            raise FileExistsError(to)
        base = Folder(self.spark, f"{target.path}.{uuid.uuid4().hex}")
        had = {p for parts in (since or {}).values() for p in parts}
        try:
            base.make("state")
            for key, parts in self.meta.get("state", {}).items():
                for p in parts:
                    if p not in had:
                        _copy_segment(self.spark, self.folder.at(p), base.at(p), key.split("/")[1])
            self.folder.copy_files("files", base)
            base.write_text("meta.json", json.dumps({k: v for k, v in self.meta.items() if k != "index"}))
            _rename(self.spark, base, target)
        except BaseException:
            base.remove()
            raise
        return self.meta.get("state", {})


def _level(segment: str) -> int:
    return int(segment.rsplit("/", 1)[1].split("-")[1])


def _copy_segment(spark: SparkSession, old: str, new: str, kind: str) -> None:
    spark.read.schema(lattice.STATES[kind]).parquet(old).write.parquet(new)


def _rename(spark: SparkSession, part: Folder, target: Folder) -> None:
    above, name = target.path.rsplit("/", 1) if "/" in target.path else (".", target.path)
    Folder(spark, above or "/").move(part.path.rsplit("/", 1)[-1], name)


def restore(backups: Sequence[str], folder: str, replace: bool = False, spark: SparkSession | None = None) -> None:
    """Makes a database of a full backup and the increments after it. An existing folder that isn't empty is kept unless replace."""
    spark = spark or SparkSession.getActiveSession()
    target = Folder(spark, folder)
    if target.path in ("", ".", ".."):
        raise ValueError(f"can't restore to {folder!r}")
    if target.names() and not replace:
        raise FileExistsError(folder)
    from_ = [Folder(spark, b) for b in backups]
    meta = json.loads(from_[-1].read_text("meta.json"))
    base = Folder(spark, f"{target.path}.{uuid.uuid4().hex}")
    try:
        for key, parts in meta.get("state", {}).items():
            for p in parts:
                source = next((b for b in reversed(from_) if b.exists(p)), None)
                if source is None:
                    raise FileNotFoundError(p)
                _copy_segment(spark, source.at(p), base.at(p), key.split("/")[1])
        for b in from_:
            b.copy_files("files", base)
        base.write_text("meta.json", json.dumps(meta))
        target.remove()
        _rename(spark, base, target)
    except BaseException:
        base.remove()
        raise


class Tenants:
    """The databases under one folder, opened when first asked for."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, Folder(spark, folder)
        self.open: dict[str, Database] = {}

    def get(self, tenant: str) -> Database:
        if tenant not in self.open:
            self.open[tenant] = Database(self.spark, self.folder.at(tenant.encode().hex()), tenant)
        return self.open[tenant]

    def names(self) -> list[str]:
        return sorted(bytes.fromhex(n).decode() for n in self.folder.names() if self.folder.exists(f"{n}/meta.json"))

    def remove(self, tenant: str) -> None:
        self.open.pop(tenant, None)
        self.folder.remove(tenant.encode().hex())

    def backup(self, to: str) -> None:
        """All tenants, with a manifest."""
        target = Folder(self.spark, to)
        target.make("tenants")
        for t in self.names():
            self.get(t).backup(target.at(f"tenants/{t.encode().hex()}"))
        target.write_text("manifest.json", json.dumps({"version": 1, "tenants": self.names()}))

    def restore(self, backup: str, replace: bool = False) -> None:
        source = Folder(self.spark, backup)
        self.folder.make()
        for t in json.loads(source.read_text("manifest.json"))["tenants"]:
            restore([source.at(f"tenants/{t.encode().hex()}")], self.folder.at(t.encode().hex()), replace, self.spark)

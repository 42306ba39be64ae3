"""Registered queries that go through Database: tables are made from the driver's, written to and merged by the engine, and read back.

Users are rows: of each event the type is written (lww), counted by three replicas (counter), put into a set (orset) and on a list (rga).
The first three users by id get the writes that a query is about.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import coerce
from .functions.hlc import Clock
from .operators import digest, gc, lattice, sync
from .plans.query import Condition, select_plan
from .plans.schema import Catalog, Index, TableSchema
from .plans.schema import Column as SchemaColumn
from .queries import _CELL_SQL, _COUNTER_SQL, _LEVELS, _LWW_SQL, _OPS, _ROW_SQL, ORDERS, _cells, _counters, _dead, _events, _hashed, _lww, _table, _tags, ops, registered
from .queries import ORACLE_SQL as ORACLE_SQL
from .queries import QUERIES as QUERIES
from .sources.database import Atoms, Database, FileImport, FloorMismatch, RowView, Table, Tenants, restore
from .sources.files import is_bad_path, read_all
from .sources.folder import workspace
from .sources.keyvalue import KeyValue
from .streaming import feed
from .streaming.mailbox import Mailbox, PartialAnswer

USERS = TableSchema(
    "users",
    (SchemaColumn("event_type"), SchemaColumn("counted", "int", "counter"), SchemaColumn("tags", "string", "orset"), SchemaColumn("history", "string", "rga"), SchemaColumn("file", "string", "file")),
    (Index("by_type", ("event_type",)),),
)


def pk_of(c: Column) -> Column:
    return F.concat(F.lit("00000000-0000-7000-8000-"), F.lpad(c.cast("string"), 12, "0"))


def _pk_sql(c: str) -> str:
    return f"'00000000-0000-7000-8000-' || lpad(CAST({c} AS VARCHAR), 12, '0')"


def _keyed(df: DataFrame, col: str) -> DataFrame:
    return df.withColumns({"pk": pk_of(F.col("pk")), "col": F.lit(col)})


def _history(o: DataFrame) -> DataFrame:
    """A list for each user: the types of its events, each put after the one before."""
    name = lambda c: F.lpad(c.cast("string"), 12, "0")
    before = F.lag(name(F.col("event_id"))).over(W.partitionBy("pk").orderBy("event_id"))
    return o.select("pk", "col", name(F.col("event_id")).alias("id"), F.encode("event_type", "utf-8").alias("value"), F.coalesce(before, F.lit("")).alias("origin"), F.col("hlc").alias("ts"), F.lit(False).alias("deleted"), F.lit(0).cast("long").alias("deleted_at"))


def _states(spark: SparkSession, sf_dir: str, *kinds: str, o: DataFrame | None = None) -> dict[str, DataFrame]:
    o = ops(spark, sf_dir) if o is None else o
    made: dict[str, Callable[[], DataFrame]] = {
        "lww": lambda: _keyed(_lww(o), "event_type"), "counter": lambda: _keyed(_counters(o), "counted"), "orset": lambda: _keyed(_tags(o), "tags"),
        "tombstone": lambda: _keyed(_dead(o), "tags"), "rga": lambda: _keyed(_history(o), "history"),
    }
    return {k: made[k]() for k in kinds}


def _users(spark: SparkSession, sf_dir: str, *kinds: str) -> tuple[Table, list[str]]:
    """A database of all users with these kinds of atoms, and the first three users."""
    t = Database.open(spark, workspace(spark), schemas=[USERS]).table("users")
    if kinds:
        t.merge(_states(spark, sf_dir, *kinds))
    return t, _picks(spark, sf_dir)


def _picks(spark: SparkSession, sf_dir: str) -> list[str]:
    return [r["pk"] for r in _events(spark, sf_dir).select(pk_of(F.col("user_id")).alias("pk")).distinct().orderBy("pk").limit(3).collect()]


_PICKS = f"picks AS (SELECT {_pk_sql('user_id')} AS pk, row_number() OVER (ORDER BY user_id) AS n FROM (SELECT DISTINCT user_id FROM events) QUALIFY n <= 3)"
_LAST = f"latest AS (SELECT {_pk_sql('pk')} AS pk, ts, value FROM ({_LWW_SQL.format(ops=_OPS)}))"
_COUNTED = f"counted AS (SELECT {_pk_sql('pk')} AS pk, CAST(sum(inc) - sum(dec) AS BIGINT) AS value FROM ({_COUNTER_SQL}) GROUP BY ALL)"
_SETS = f"sets AS (SELECT {_pk_sql('user_id')} AS pk, list_sort(list(DISTINCT event_type)) AS tags FROM events WHERE event_id % 5 <> 0 GROUP BY ALL)"
_LISTS = f"lists AS (SELECT {_pk_sql('user_id')} AS pk, list(event_type ORDER BY event_id) AS h FROM events GROUP BY ALL)"


def _rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _values(rows: list[tuple], names: str) -> str:
    """SQL of rows that are given."""
    one = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else f"CAST({v} AS BIGINT)" if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) AS t({names})"


def _joined(c: str) -> Column:
    return F.array_join(c, ",").alias(c)


# Reads.


@registered("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey = (SELECT min(o_orderkey) FROM orders WHERE o_custkey > 10)")
def point_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of a database of all orders: the filter on pk reaches the scan of its segments."""
    orders = _table(spark, sf_dir, "orders")
    names = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"]
    kinds = {c.name: c.type for c in ORDERS.columns}
    cells = F.explode(F.array(*(F.struct(F.lit(n).alias("col"), coerce.stored(F.col(n), kinds[n]).alias("value")) for n in names)))
    t = Database.open(spark, workspace(spark), schemas=[ORDERS]).table("orders")
    t.merge({"lww": orders.select(pk_of(F.col("o_orderkey")).alias("pk"), F.lit(1).cast("long").alias("ts"), cells.alias("c")).select("pk", "c.col", "ts", "c.value")})
    key = orders.where("o_custkey > 10").agg(F.min("o_orderkey")).select(pk_of(F.col("min(o_orderkey)"))).first()[0]
    got = t.get(key)
    return _rows(spark, [tuple(got[n] for n in names)], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double")


@registered(f"WITH {_LAST} SELECT pk, value AS event_type FROM latest")
def table_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, _ = _users(spark, sf_dir, "lww")
    return t.scan(desc=True).select("pk", "event_type")


@registered(f"WITH {_LAST} SELECT pk, 'event_type' AS col, 'lww' AS kind, '{{\"ts\":' || ts || ',\"value\":\"' || base64(encode(value)) || '\"}}' AS atom FROM latest")
def raw_row_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _users(spark, sf_dir, "lww")[0].raw_rows()


@registered(f"WITH {_PICKS}, {_LAST} SELECT 'event_type' AS col, ts, value, 1 AS found, 0 AS missing FROM latest JOIN picks USING (pk) WHERE n = 2")
def raw_row_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One column's atoms of a row that has others; a column without atoms is an error."""
    t, picks = _users(spark, sf_dir, "lww", "orset")
    missing = 0
    try:
        t.raw(picks[1], ["nothing"])
        missing = 1
    except KeyError:
        pass
    got = t.raw(picks[1], ["event_type"])
    return got["lww"].select("col", "ts", F.decode("value", "utf-8").alias("value"), F.lit(1).alias("found"), F.lit(missing).alias("missing"))


@registered(_values([(k, 0) for k in lattice.STATES], "kind, atoms"))
def raw_get_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row that isn't there has empty states and no error."""
    t, _ = _users(spark, sf_dir, "lww", "orset", "tombstone")
    states = t.get_states("00000000-0000-7000-8000-ffffffffffff")
    return lattice.union([d.agg(F.count("*").alias("atoms")).select(F.lit(k).alias("kind"), "atoms") for k, d in states.items()])


@registered(f"WITH {_LAST}, {_SETS} SELECT pk, 'lww' AS kind, CAST(1 AS BIGINT) AS atoms FROM latest WHERE value = 'click' UNION ALL SELECT {_pk_sql('user_id')}, 'orset', count(*) FROM events WHERE event_id % 5 <> 0 AND {_pk_sql('user_id')} IN (SELECT pk FROM latest WHERE value = 'click') GROUP BY 1")
def find_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, _ = _users(spark, sf_dir, "lww", "orset", "tombstone")
    found = t.find_states(t.where("event_type", "=", "click"))
    return lattice.union([found[k].groupBy("pk").agg(F.count("*").alias("atoms")).select("pk", F.lit(k).alias("kind"), "atoms") for k in ("lww", "orset")])


@registered(f"WITH {_PICKS}, {_LAST}, {_COUNTED}, {_SETS}, {_LISTS} SELECT pk, l.value AS string, c.value AS number, len(h) AS items, list_contains(tags, 'click') AS clicked, CAST(NULL AS BIGINT) AS wrong FROM picks JOIN latest l USING (pk) JOIN counted c USING (pk) JOIN sets USING (pk) JOIN lists USING (pk)")
def typed_getters(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, picks = _users(spark, sf_dir, "lww", "counter", "orset", "tombstone", "rga")
    rows: list[RowView] = [t.row(p) for p in picks]
    return _rows(spark, [(r.pk, r.get_string("event_type"), r.get_int("counted"), len(r.get_list("history")), r.contains("tags", "click"), r.get_int("event_type")) for r in rows], "pk string, string string, number long, items long, clicked boolean, wrong long")


@registered(f"WITH {_LAST} SELECT event_type, pk FROM (SELECT value AS event_type, pk FROM latest) WHERE event_type >= 'p'")
def index_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range of the index that reindex() wrote: its filter reaches the scan of a table sorted by it."""
    t, _ = _users(spark, sf_dir, "lww")
    t.reindex()
    return t.index("by_type").where("event_type >= 'p'")


@registered(f"WITH {_PICKS}, {_LAST} SELECT value AS event_type, pk FROM latest WHERE pk NOT IN (SELECT pk FROM picks WHERE n = 1) UNION ALL SELECT 'zz', pk FROM picks WHERE n = 1")
def index_maintained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index after a write: rows without the column aren't in it, and the old entry is gone."""
    t, picks = _users(spark, sf_dir, "lww", "orset")
    t.reindex()
    t.set(picks[0], {"event_type": "zz"})
    return t.index("by_type")


@registered(_values([("eq_range", "ab", 15), ("eq", "a", 10), ("range", "c", 5), ("none", None, 0)], "case_name, index_name, score"))
def plan_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = TableSchema("t", tuple(SchemaColumn(c) for c in "abc"), (Index("a", ("a",)), Index("ab", ("a", "b")), Index("c", ("c",))))
    cases = {"eq_range": [("a", "="), ("b", ">")], "eq": [("a", "=")], "range": [("c", "<")], "none": [("a", "IN"), ("b", "!=")]}
    plans = {k: select_plan(s, [Condition(f, op, "x") for f, op in v]) for k, v in cases.items()}
    return _rows(spark, [(k, p.index.name if p.index else None, p.score) for k, p in plans.items()], "case_name string, index_name string, score long")


@registered(_values([("struct", "ValueError"), ("nan", "ValueError"), ("text number", "ValueError"), ("set", "ValueError"), ("first of two", "ValueError"), ("fine", "")], "case_name, error"))
def normalization_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Literals of another type, and predicates on sets, are reported when the query is run, the first one of several."""
    t, _ = _users(spark, sf_dir)
    cases = {
        "struct": t.where("counted", ">", object()), "nan": t.where("counted", "=", float("nan")), "text number": t.where("counted", "=", " 7 "), "set": t.where("tags", "=", "x"),
        "first of two": t.where("counted", "=", "x").and_("event_type", "=", "y"), "fine": t.where("counted", "=", "7"),
    }
    out = []
    for k, q in cases.items():
        try:
            q.find()
            out.append((k, ""))
        except ValueError:
            out.append((k, "ValueError"))
    return _rows(spark, out, "case_name string, error string")


# Writes.


@registered(f"WITH {_PICKS}, {_LAST} SELECT pk, coalesce('set ' || n, value) AS event_type FROM latest LEFT JOIN picks USING (pk)")
def set_lww(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, picks = _users(spark, sf_dir, "lww")
    with t.db.update():
        for i, p in enumerate(picks, 1):
            t.set(p, {"event_type": f"set {i}"})
    return t.wide().select("pk", "event_type")


@registered(f"WITH {_PICKS} SELECT pk, 'extra ' || n AS note FROM picks")
def set_undeclared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column that the schema doesn't declare is a string register, and is read with its row."""
    t, picks = _users(spark, sf_dir, "counter")
    with t.db.update():
        for i, p in enumerate(picks, 1):
            t.set(p, {"note": f"extra {i}"})
    return _rows(spark, [(p, t.row(p).get_string("note")) for p in picks], "pk string, note string")


@registered(f"WITH {_PICKS}, {_COUNTED} SELECT pk, CAST(CASE n WHEN 1 THEN 5 WHEN 2 THEN -3 WHEN 3 THEN value + 7 - 2 ELSE value END AS BIGINT) AS counted FROM counted LEFT JOIN picks USING (pk)")
def counter_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set moves a counter to a value, add and remove count up and down."""
    t, picks = _users(spark, sf_dir, "counter")
    with t.db.update():
        t.set(picks[0], {"counted": 5})
        t.set(picks[1], {"counted": -3.0})
        t.add(picks[2], "counted", 7)
        t.remove(picks[2], "counted", 2)
    return t.wide().select("pk", "counted")


def _set_result(t: Table) -> DataFrame:
    return t.wide().where("tags is not null").select("pk", _joined("tags"))


@registered(f"WITH {_PICKS}, {_SETS} SELECT pk, array_to_string(CASE n WHEN 1 THEN ['only'] WHEN 3 THEN list_sort(list_distinct(list_append(tags, 'new'))) ELSE tags END, ',') AS tags FROM sets LEFT JOIN picks USING (pk) WHERE coalesce(n, 0) <> 2")
def orset_set_and_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set leaves one element or, with None, none; add puts one in, twice."""
    t, picks = _users(spark, sf_dir, "orset", "tombstone")
    with t.db.update():
        t.set(picks[0], {"tags": "only"})
        t.set(picks[1], {"tags": None})
        t.add(picks[2], "tags", "new")
        t.add(picks[2], "tags", "new")
    return _set_result(t)


@registered(f"WITH {_PICKS}, {_SETS}, c AS (SELECT pk, CASE WHEN n IS NULL THEN tags ELSE list_filter(tags, lambda x: x <> 'click') END AS tags FROM sets LEFT JOIN picks USING (pk)) SELECT pk, array_to_string(tags, ',') AS tags FROM c WHERE len(tags) > 0")
def orset_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, picks = _users(spark, sf_dir, "orset", "tombstone")
    with t.db.update():
        for p in picks:
            t.remove(p, "tags", "click")
    return _set_result(t)


@registered(f"WITH {_PICKS}, {_SETS}, {_COUNTED} SELECT pk, CAST(CASE n WHEN 2 THEN 12 ELSE value END AS BIGINT) AS counted, array_to_string(CASE n WHEN 2 THEN list_sort(list_distinct(list_append(tags, 'copied'))) ELSE tags END, ',') AS tags FROM counted JOIN sets USING (pk) LEFT JOIN picks USING (pk)")
def set_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Atoms of a lattice are stored as they are: a counter's of replicas that the row doesn't have, and a tag of a set."""
    t, picks = _users(spark, sf_dir, "counter", "orset", "tombstone")
    now = t.row(picks[1]).get_int("counted")
    t.set(picks[1], {"counted": Atoms("counter", (("x", max(0, 12 - now), 0), ("y", 0, max(0, now - 12)))), "tags": Atoms("orset", ((b"copied", "tag of mine"),))})
    return t.wide().where("tags is not null").select("pk", "counted", _joined("tags"))


def _list_result(t: Table) -> DataFrame:
    return t.wide().where("history is not null").select("pk", _joined("history"))


def _list_sql(*edits: str) -> str:
    """Lists, those of the three users after an edit each (SQL of h)."""
    return f"WITH {_PICKS}, {_LISTS}, c AS (SELECT pk, CASE n {' '.join(f'WHEN {i} THEN {e}' for i, e in enumerate(edits, 1))} ELSE h END AS h FROM lists LEFT JOIN picks USING (pk)) SELECT pk, array_to_string(h, ',') AS history FROM c WHERE len(h) > 0"


@registered(_list_sql("list_concat(h, ['last', 'later'])", "['one']", "[]"))
def rga_append_and_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, picks = _users(spark, sf_dir, "rga")
    with t.db.update():
        t.add(picks[0], "history", "last")
        t.add(picks[0], "history", "later")
        t.set(picks[1], {"history": "one"})
        t.set(picks[2], {"history": None})
    return _list_result(t)


@registered(_list_sql("list_concat(['first'], h)", "list_concat(h[:2], ['third'], h[3:])", "list_concat(h[:1], ['second'], h[2:])"))
def rga_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By index, and after a value's first occurrence; indexes beyond the end and unknown values are errors."""
    t, picks = _users(spark, sf_dir, "rga")
    head = t.row(picks[2]).get_list("history")[0]
    with t.db.update():
        t.insert_at(picks[0], "history", 0, "first")
        t.insert_at(picks[1], "history", 2, "third")
        t.insert_after(picks[2], "history", head, "second")
    for call, error in ((lambda: t.insert_at(picks[0], "history", 10**6, "x"), IndexError), (lambda: t.insert_after(picks[0], "history", "nowhere", "x"), LookupError)):
        try:
            call()
            raise AssertionError("no error")
        except error:
            pass
    return _list_result(t)


@registered(_list_sql("list_concat(h[:1], h[3:])", "list_filter(h, lambda x: x <> 'view')", "h[2:]"))
def rga_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, picks = _users(spark, sf_dir, "rga")
    with t.db.update():
        t.remove_at(picks[0], "history", 1)
        t.remove(picks[1], "history", "view")
        t.remove_at(picks[2], "history", 0)
    return _list_result(t)


@registered(f"WITH {_PICKS} SELECT pk, 'docs/' || n || '.bin' AS path, sha256('content ' || n) AS hash, CAST(9 AS BIGINT) AS size, true AS kept FROM picks")
def file_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files imported into a database's folder, one of them after an import that was rolled back."""
    t, picks = _users(spark, sf_dir)
    with tempfile.TemporaryDirectory() as here:
        for i, p in enumerate(picks, 1):
            at = os.path.join(here, "in")
            for text, fails in (("undone", i == 2), (f"content {i}", False)):
                with open(at, "w") as f:
                    f.write(text)
                if text == "undone" and not fails:
                    continue
                try:
                    with t.db.update():
                        t.set(p, {"file": FileImport(at, f"docs\\{i}.bin")})
                        if fails:
                            raise InterruptedError
                except InterruptedError:
                    pass
    files = read_all(spark, t.db.folder.at("files")).select("path", "hash", "size")
    return t.wide().select("pk", "file.*").join(files.withColumn("kept", F.lit(True)), ["path", "hash", "size"])


@registered(_values([("remove of a register", "ValueError"), ("file without import", "ValueError"), ("counter of a fraction", "ValueError"), ("key that is no version 7", "ValueError"), ("atoms of another kind", "ValueError")], "case_name, error"))
def write_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, picks = _users(spark, sf_dir)
    cases = {
        "remove of a register": lambda: t.remove(picks[0], "event_type", "x"), "file without import": lambda: t.set(picks[0], {"file": "x"}), "counter of a fraction": lambda: t.set(picks[0], {"counted": 1.5}),
        "key that is no version 7": lambda: t.set("00000000-0000-4000-8000-000000000000", {"event_type": "x"}), "atoms of another kind": lambda: t.set(picks[0], {"tags": Atoms("lww", ((1, b"x"),))}),
    }
    out = []
    for k, call in cases.items():
        try:
            call()
            out.append((k, ""))
        except ValueError:
            out.append((k, "ValueError"))
    return _rows(spark, out, "case_name string, error string")


@registered(f"WITH {_PICKS}, {_LAST}, {_COUNTED} SELECT pk, CASE WHEN n = 1 THEN 'kept' ELSE l.value END AS event_type, CAST(c.value + CASE WHEN n = 1 THEN 1 ELSE 0 END AS BIGINT) AS counted FROM latest l JOIN counted c USING (pk) LEFT JOIN picks USING (pk)")
def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of a transaction's writes are there or, after an exception, none."""
    t, picks = _users(spark, sf_dir, "lww", "counter")
    with t.db.update():
        t.set(picks[0], {"event_type": "kept"})
        t.add(picks[0], "counted", 1)
    try:
        with t.db.update():
            t.set(picks[1], {"event_type": "lost"})
            t.add(picks[1], "counted", 100)
            raise InterruptedError
    except InterruptedError:
        pass
    return t.wide().select("pk", "event_type", "counted")


@registered(f"WITH {_LAST} SELECT pk, value AS event_type, CAST(1 AS BIGINT) AS segments FROM latest WHERE pk NOT IN (SELECT {_pk_sql('min(user_id)')} FROM events) UNION ALL SELECT {_pk_sql('min(user_id)')}, 'write 19', 1 FROM events")
def compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty commits to a large state are twenty small segments, of which sixteen become one; a compaction leaves one in all."""
    t, picks = _users(spark, sf_dir, "lww")
    for i in range(20):
        t.set(picks[0], {"event_type": f"write {i}"})
    assert len(t.db._version("users")["users/lww"]) < 16
    t.db.compact()
    return t.wide().select("pk", "event_type", F.lit(len(t.db._version("users")["users/lww"])).cast("long").alias("segments"))


# Merges, clocks and sync.


@registered(f"WITH {_LAST}, {_COUNTED}, {_SETS} SELECT pk, l.value AS event_type, c.value AS counted, array_to_string(tags, ',') AS tags FROM latest l JOIN counted c USING (pk) LEFT JOIN sets USING (pk)")
def merge_raw_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three replicas' rows of columns of several kinds, taken in one after the other, one of them twice."""
    t, _ = _users(spark, sf_dir)
    o = ops(spark, sf_dir)
    every = _states(spark, sf_dir, "counter", "orset", "tombstone")
    for r in (2, 0, 1, 0):
        mine = _states(spark, sf_dir, "lww", o=o.where(F.col("replica") == r))
        if r:
            mine |= {"counter": every["counter"].where(F.col("node") != str(3 - r)), "orset": every["orset"], "tombstone": every["tombstone"]}
        t.merge(mine, peer=f"r{r}")
    return t.wide().select("pk", "event_type", "counted", _joined("tags"))


@registered(f"WITH {_PICKS}, {_LAST} SELECT pk, coalesce('after', value) AS event_type FROM picks JOIN latest USING (pk) UNION ALL SELECT pk, value FROM latest WHERE pk NOT IN (SELECT pk FROM picks)")
def write_after_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A peer's clock is two hours ahead; what is written here after its atoms came in still wins, as the clock moved beyond them."""
    t, picks = _users(spark, sf_dir)
    ahead = (Clock().now() >> 16) + 7_200_000 << 16
    o = ops(spark, sf_dir)
    late = F.lit(ahead) - F.lit(o.agg(F.max("hlc")).first()[0])
    t.merge({"lww": _states(spark, sf_dir, "lww")["lww"].withColumn("ts", F.col("ts") + late)})
    with t.db.update():
        for p in picks:
            t.set(p, {"event_type": "after"})
    return t.wide().select("pk", "event_type")


@registered(f"WITH {_LISTS} SELECT pk, array_to_string(h, ',') AS history FROM lists")
def rga_merge_into_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists that come into an empty database in two halves, the later one first, hang on the one virtual head."""
    t, _ = _users(spark, sf_dir)
    every = _states(spark, sf_dir, "rga")["rga"]
    for odd in (1, 0):
        t.merge({"rga": every.where(F.col("id").cast("long") % 2 == odd)}, peer=f"r{odd}")
    return _list_result(t)


@registered(f"WITH {_CELL_SQL} SELECT {_pk_sql('pk')} AS pk, col, value FROM merged WHERE col <> 'replica'")
def delta_receive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of a delta come in, the others don't; rows that are new are made."""
    cells = _cells(ops(spark, sf_dir)).drop("replica").withColumn("pk", pk_of(F.col("pk")))
    db = Database.open(spark, workspace(spark), schemas=[TableSchema("cells")])
    t = db.table("cells")
    t.merge({"lww": cells.where("ts % 2 = 0 and col <> 'replica'")})
    t.merge({"lww": sync.delta(cells, ["type", "digit"])})
    return t.state("lww").select("pk", "col", F.decode("value", "utf-8").alias("value"))


@registered(_values([("equal", "pass", 5), ("peer behind", "block", 5), ("peer ahead, a delta", "block", 5), ("peer ahead, full", "pass", 9), ("no floors", "pass", 0)], "case_name, outcome, floor_after"))
def floor_gate_on_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Atoms of a peer with another floor are blocked; full states of one that is ahead are taken and its floor adopted."""
    out = []
    for name, local, peer, full in (("equal", 5, 5, False), ("peer behind", 5, 3, True), ("peer ahead, a delta", 5, 9, False), ("peer ahead, full", 5, 9, True), ("no floors", 0, -1, False)):
        t, picks = _users(spark, sf_dir)
        if local:
            t.db.gc(local)
        try:
            t.merge({"lww": _rows(spark, [(picks[0], "event_type", 1, b"x")], lattice.STATES["lww"])}, peer_floor=peer, full=full)
            out.append((name, "pass", t.db.gc_floor))
        except FloorMismatch:
            out.append((name, "block", t.db.gc_floor))
    return _rows(spark, out, "case_name string, outcome string, floor_after long")


@registered(_values([("now", 10 << 16), ("now, same ms", (10 << 16) + 1), ("update, seen ahead", (20 << 16) + 6), ("now, behind what was seen", (20 << 16) + 7), ("now, later", 30 << 16), ("update, seen behind", (30 << 16) + 1), ("counter is full", 41 << 16)], "step, hlc"))
def hlc_now_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = [10]
    clock, out = Clock(lambda: at[0]), []
    for step, millis, seen in (("now", 10, None), ("now, same ms", 10, None), ("update, seen ahead", 10, (20 << 16) + 5), ("now, behind what was seen", 11, None), ("now, later", 30, None), ("update, seen behind", 30, 4), ("counter is full", 30, (40 << 16) + 65535)):
        at[0] = millis
        out.append((step, clock.now() if seen is None else clock.update(seen)))
    return _rows(spark, out, "step string, hlc long")


@registered("SELECT doc_id, sha256(text) AS hash, CAST(strlen(text) AS BIGINT) AS size FROM documents WHERE text IS NOT NULL")
def file_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut into chunks, these dealt anew, put together in order, and checked by size and hash."""
    d = _table(spark, sf_dir, "documents").where("text is not null")
    files = d.select(F.col("doc_id").cast("string").alias("path"), F.octet_length("text").cast("long").alias("size"), F.sha2("text", 256).alias("hash"), F.encode("text", "utf-8").alias("content"))
    plan = sync.chunk_plan(files.select("path", "size", "hash"), 2048, 512)
    sent = plan.join(files.select("path", "content"), "path").select("path", "chunk", "chunks", "hash", "offset", F.substring("content", (F.col("offset") + 1).cast("int"), F.col("length").cast("int")).alias("bytes"), F.sum("length").over(W.partitionBy("path")).alias("size"))
    got = sync.assembled(sent)
    return got.select(F.col("path").cast("long").alias("doc_id"), F.sha2("content", 256).alias("hash"), F.octet_length("content").cast("long").alias("size"))


@registered(_values([("in order", "whole"), ("out of order", "ValueError"), ("wrong bytes", "ValueError"), ("too late", "ValueError"), ("too many bytes", "ValueError")], "case_name, outcome"))
def chunk_receiver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A receiver takes a file's chunks in strict order, within five minutes of each other, and checks size and hash."""
    import hashlib

    data = bytes(range(200)) * 10
    parts = [data[i : i + 512] for i in range(0, len(data), 512)]
    sound = hashlib.sha256(data).hexdigest()
    cases = {
        "in order": [(i, p, 0) for i, p in enumerate(parts)], "out of order": [(1, parts[1], 0)], "wrong bytes": [(i, bytes(len(p)), 0) for i, p in enumerate(parts)],
        "too late": [(0, parts[0], 0), (1, parts[1], sync.CHUNK_EXPIRY_MILLIS + 1)], "too many bytes": [(i, p + b"x", 0) for i, p in enumerate(parts)],
    }
    out = []
    for name, chunks in cases.items():
        r = sync.ChunkReceiver()
        try:
            whole = None
            for i, p, late in chunks:
                whole = r.accept("peer", "f.bin", i, len(parts), p, sound, len(data), 1000 + late)
            out.append((name, "whole" if whole == data else "part"))
        except ValueError:
            out.append((name, "ValueError"))
    return _rows(spark, out, "case_name string, outcome string")


@registered(_values([(m,) for m in sync.MESSAGES], "kind"))
def message_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One message of each kind through its envelope."""
    sent = _rows(spark, [(m, "tenant", "node", str(i)) for i, m in enumerate(sync.MESSAGES)], "kind string, tenant string, sender string, request_id string")
    return sync.messages(sent).select("kind")


# Garbage.


@registered(f"WITH o AS ({_OPS}), safe AS (SELECT (epoch_us(min(ts)) // 1000 + 3 * 86400000) * 65536 AS s FROM events) SELECT 'orset' AS kind, count(*) AS removed, max(s) AS floor_after FROM o, safe WHERE event_id % 5 = 0 AND hlc < s UNION ALL SELECT 'tombstone', count(*), max(s) FROM o, safe WHERE event_id % 5 = 0 AND hlc < s UNION ALL SELECT 'rga', 0, max(s) FROM safe")
def gc_database(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collection in all tables: tombstones before the safe time and their tags go; the floor rises and doesn't fall again."""
    t, _ = _users(spark, sf_dir, "orset", "tombstone", "rga")
    safe = (ops(spark, sf_dir).agg(F.min("hlc")).first()[0] >> 16) + 3 * 86_400_000 << 16
    gone = t.db.gc(safe)
    t.db.gc(5)
    return _rows(spark, [(k, gone.get(k, 0), t.db.gc_floor) for k in ("orset", "tombstone", "rga")], "kind string, removed long, floor_after long")


@registered(f"WITH {_LAST}, {_COUNTED} SELECT pk, l.value AS event_type, c.value AS counted FROM latest l JOIN counted c USING (pk)")
def gc_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registers and counters have no garbage."""
    t, _ = _users(spark, sf_dir, "lww", "counter")
    t.db.gc(1 << 62)
    return t.wide().select("pk", "event_type", "counted")


@registered(f"WITH n AS (SELECT max(hlc) AS now FROM ({_OPS})) SELECT off AS offset_millis, CASE WHEN off <= 0 THEN now ELSE (greatest((now >> 16) - off, 0) << 16) | (now & 65535) END AS safe_ts FROM n, (SELECT unnest([CAST(-1 AS BIGINT), 0, 30000, 99999999999999]) AS off)")
def gc_by_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = ops(spark, sf_dir).agg(F.max("hlc")).first()[0]
    return _rows(spark, [(off, gc.safe_by_offset(now, off)) for off in (-1, 0, 30_000, 99_999_999_999_999)], "offset_millis long, safe_ts long")


@registered("SELECT (min(m) << 16) - (CAST(30000 AS BIGINT) << 16) AS agreed, CAST(3 AS BIGINT) AS ran, (min(m) << 16) - (CAST(30000 AS BIGINT) << 16) AS floor_after FROM (SELECT max(epoch_us(ts) // 1000) AS m FROM events GROUP BY event_id % 3)")
def manual_gc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three replicas agree on the least of their safe times, and all collect up to it."""
    clocks = _events(spark, sf_dir).groupBy((F.col("event_id") % 3).alias("r")).agg((F.max(F.unix_millis("ts")) * 65536).alias("clock"))
    tables = [_users(spark, sf_dir)[0] for _ in range(3)]
    members = [t.db.member(lambda i=i: clocks.where(F.col("r") == i)) for i, t in enumerate(tables)]
    ts = gc.agree(members[0], members[1:], "request")
    return _rows(spark, [(ts, sum(t.db.gc_floor == ts for t in tables), min(t.db.gc_floor for t in tables))], "agreed long, ran long, floor_after long")


@registered(_values([("no id", "ValueError"), ("no time", "ValueError"), ("beyond the safe time", "ValueError"), ("commit without prepare", "ValueError"), ("execute without commit", "ValueError"), ("another is pending", "ValueError"), ("a peer refuses", "ValueError"), ("left pending", "0")], "case_name, outcome"))
def manual_gc_handlers(spark: SparkSession, sf_dir: str) -> DataFrame:
    fresh = lambda safe=100: gc.Member(lambda: safe, lambda _: None)
    busy, refusing, local = fresh(), fresh(), fresh()
    busy.prepare("a", 50)
    refusing.prepare("other", 50)
    cases = {
        "no id": lambda: fresh().prepare("", 5), "no time": lambda: fresh().prepare("r", 0), "beyond the safe time": lambda: fresh().prepare("r", 101), "commit without prepare": lambda: fresh().commit("r", 5),
        "execute without commit": lambda: busy.execute("a", 50), "another is pending": lambda: busy.prepare("b", 50), "a peer refuses": lambda: gc.agree(local, [refusing], "r"),
    }
    out = []
    for k, call in cases.items():
        try:
            call()
            out.append((k, ""))
        except ValueError:
            out.append((k, "ValueError"))
    out.append(("left pending", str(len(local.pending))))
    return _rows(spark, out, "case_name string, outcome string")


# Digests.


@registered("SELECT CAST(0 AS BIGINT) AS differing, count(DISTINCT user_id) AS rows_compared, true AS same_root FROM events")
def digests_converge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two databases that took the same atoms in other orders and pieces have the same digests and the same root."""
    a, _ = _users(spark, sf_dir, "lww", "orset", "tombstone")
    b, _ = _users(spark, sf_dir)
    for k in ("tombstone", "orset", "lww"):
        d = _states(spark, sf_dir, k)[k]
        b.merge({k: d.where("crc32(cast(pk as binary)) % 2 = 0")})
        b.merge({k: d.where("crc32(cast(pk as binary)) % 3 <> 0 or crc32(cast(pk as binary)) % 2 = 1")})
    mine, theirs = a.digests(), b.digests()
    both = mine.join(theirs.withColumnRenamed("digest", "other"), "pk", "full_outer")
    same = digest.root(a.merkle()) == digest.root(b.merkle())
    return both.agg(F.sum((~F.col("digest").eqNullSafe(F.col("other"))).cast("long")).alias("differing"), F.count("*").alias("rows_compared")).withColumn("same_root", F.lit(same))


@registered(f"WITH r AS ({_ROW_SQL}), few AS (SELECT min(substring(key, 1, 4)) AS prefix FROM r) SELECT key, digest FROM r, few WHERE starts_with(key, prefix)")
def merkle_leaf_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _hashed(spark, sf_dir)
    return digest.leaf_rows(rows, rows.agg(F.min(F.substring("key", 1, 4))).first()[0])


@registered(f"SELECT prefix, hash FROM ({_LEVELS[1]}) WHERE prefix LIKE '0%' AND length(prefix) = 3 AND substring(prefix, 1, 2) = '00' UNION ALL SELECT prefix, hash FROM ({_LEVELS[2]}) WHERE prefix = '00'")
def merkle_node_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = digest.stored_tree(_hashed(spark, sf_dir), workspace(spark))
    return digest.children(nodes, "00").select("prefix", "hash").unionByName(_rows(spark, [("00", digest.node(nodes, "00"))], "prefix string, hash string").where("hash <> ''"))


# Feeds and streams.


@registered(f"WITH {_PICKS} SELECT CAST(n + 1 AS BIGINT) AS seq, pk, 'event_type' AS col, 'lww' AS kind, 'by ' || n AS value FROM picks")
def change_feed_of_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of a database's own writes, after a merge, which the local feed leaves out."""
    t, picks = _users(spark, sf_dir, "lww")
    for i, p in enumerate(picks, 1):
        t.set(p, {"event_type": f"by {i}"})
    local = feed.changes(t.db.log(), ["users"], ["event_type"], True, t.db.replica)
    return local.join(t.db.log().select("seq", F.decode("value", "utf-8").alias("value")), "seq").where("value is not null").select("seq", "pk", "col", "kind", "value")


@registered(f"WITH {_PICKS} SELECT DISTINCT {_pk_sql('user_id')} AS pk, 'tags' AS col, 'r1' AS source FROM events UNION ALL SELECT pk, 'tags', 'own' FROM picks WHERE n = 1")
def observed_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local writes and what came from a peer."""
    t, picks = _users(spark, sf_dir)
    t.merge(_states(spark, sf_dir, "orset"), peer="r1")
    t.add(picks[0], "tags", "x")
    source = F.when(F.col("source") == t.db.replica, "own").otherwise(F.col("source"))
    return feed.changes(t.db.log(), ["users"]).select("pk", "col", source.alias("source"))


@registered(f"WITH {_PICKS} SELECT CAST(n AS BIGINT) AS seq, pk, false AS more FROM picks WHERE n = 3")
def wait_for_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest event after a sequence number; none comes after that."""
    t, picks = _users(spark, sf_dir)
    for p in picks:
        t.add(p, "counted", 1)
    last = feed.wait_for_change(lambda: feed.changes(t.db.log(), ["users"], ["counted"]), 1, 5)
    more = feed.wait_for_change(lambda: feed.changes(t.db.log(), ["users"]), last["seq"], 0.2, 0.1)
    return _rows(spark, [(last["seq"], last["pk"], more is not None)], "seq long, pk string, more boolean")


def _streamed(spark: SparkSession, sf_dir: str, kind: str) -> tuple[Table, dict[str, float]]:
    """A database that a stream of an operation log is merged into, some files at a time, the latest writes first."""
    t, _ = _users(spark, sf_dir)
    states = _states(spark, sf_dir, *(["orset", "tombstone"] if kind == "orset" else [kind]))
    names = [x.split()[0] for x in feed.OPLOG.split(", ")]
    types = {x.split()[0]: x.split()[1] for x in feed.OPLOG.split(", ")}
    parts = [d.select(*((F.col(n) if n in d.columns else F.lit(k) if n == "kind" else F.lit("users") if n == "tbl" else F.lit(None)).cast(types[n]).alias(n) for n in names)) for k, d in states.items()]
    at = workspace(spark)
    lattice.union(parts).repartition(6).write.parquet(at)
    query = feed.merge_into(feed.read_log(spark, at, 2), t, list(states), f"{at}-checkpoint")
    query.awaitTermination(600)
    return t, {"rows": sum(p["numInputRows"] for p in query.recentProgress), "batches": sum(p["numInputRows"] > 0 for p in query.recentProgress)}


@registered(f"WITH {_LAST}, n AS (SELECT count(*) AS c FROM events) SELECT pk, value AS event_type, c AS rows_read, true AS in_batches FROM latest, n")
def stream_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of writes merged batch by batch: all are read, none dropped, and late ones count as any other."""
    t, stats = _streamed(spark, sf_dir, "lww")
    return t.wide().select("pk", "event_type", F.lit(stats["rows"]).cast("long").alias("rows_read"), F.lit(stats["batches"] > 1).alias("in_batches"))


@registered(f"WITH {_SETS} SELECT pk, array_to_string(tags, ',') AS tags FROM sets")
def stream_merge_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags and tombstones of one log are applied together, whichever comes first."""
    return _set_result(_streamed(spark, sf_dir, "orset")[0])


# Backups, tenants and files.


@registered(f"WITH {_PICKS}, {_LAST} SELECT pk, CASE WHEN n = 1 THEN 'later' ELSE value END AS event_type FROM latest LEFT JOIN picks USING (pk)")
def backup_and_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A full backup and an increment, restored elsewhere."""
    t, picks = _users(spark, sf_dir, "lww")
    at = workspace(spark)
    first = t.db.backup(f"{at}/full")
    t.set(picks[0], {"event_type": "later"})
    t.db.backup(f"{at}/more", first)
    restore([f"{at}/full", f"{at}/more"], f"{at}/back", spark=spark)
    return Database.open(spark, f"{at}/back").table("users").wide().select("pk", "event_type")


@registered(f"WITH {_LAST} SELECT t AS tenant, pk, value AS event_type FROM latest, (SELECT unnest(['a', 'b/é']) AS t) WHERE (substring(pk, 36, 1) IN ('0', '2', '4', '6', '8')) = (t = 'a')")
def tenant_backups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tenants found in a folder, backed up with a manifest and restored; one that was removed isn't among them."""
    at = workspace(spark)
    tenants = Tenants(spark, f"{at}/all")
    rows = _states(spark, sf_dir, "lww")["lww"]
    for name, even in (("a", True), ("b/é", False), ("c", True)):
        tenants.get(name).define(USERS).merge({"lww": rows.where((F.substring("pk", 36, 1).cast("int") % 2 == 0) == even)})
    tenants.remove("c")
    tenants.backup(f"{at}/saved")
    back = Tenants(spark, f"{at}/back")
    back.restore(f"{at}/saved")
    return lattice.union([back.get(n).table("users").wide().select(F.lit(n).alias("tenant"), "pk", "event_type") for n in back.names()])


@registered(_values([("restore over a database", "FileExistsError"), ("restore to ..", "ValueError"), ("backup onto a backup", "FileExistsError"), ("another tenant's", "ValueError"), ("table declared otherwise", "ValueError"), ("type json", "ValueError"), ("index on a set", "ValueError")], "case_name, error"))
def open_and_backup_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = workspace(spark)
    db = Database.open(spark, f"{at}/db", schemas=[USERS])
    db.backup(f"{at}/saved")
    cases = {
        "restore over a database": lambda: restore([f"{at}/saved"], f"{at}/db", spark=spark), "restore to ..": lambda: restore([f"{at}/saved"], "..", spark=spark), "backup onto a backup": lambda: db.backup(f"{at}/saved"),
        "another tenant's": lambda: Database.open(spark, f"{at}/db", tenant="x"), "table declared otherwise": lambda: db.define(TableSchema("users")), "type json": lambda: Catalog().add(TableSchema("t", (SchemaColumn("a", "json"),))),
        "index on a set": lambda: Catalog().add(TableSchema("t", (SchemaColumn("s", crdt="orset"),), (Index("i", ("s",)),))),
    }
    out = []
    for k, call in cases.items():
        try:
            call()
            out.append((k, ""))
        except (ValueError, FileExistsError) as e:
            out.append((k, type(e).__name__))
    return _rows(spark, out, "case_name string, error string")


@registered("SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN false WHEN 1 THEN true WHEN 2 THEN true WHEN 3 THEN true WHEN 4 THEN false WHEN 5 THEN true ELSE false END AS bad FROM documents")
def path_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id").cast("string")
    path = F.element_at(F.array(F.concat(F.lit(" a\\"), d), F.concat(F.lit("/a/"), d), F.concat(F.lit("a/../../"), d), F.concat(F.lit("c:"), d), F.concat(F.lit("a/../"), d), F.lit(".."), F.concat(F.lit("a/./"), d)), (F.col("doc_id") % 7 + 1).cast("int"))
    return _table(spark, sf_dir, "documents").select("doc_id", is_bad_path(path).alias("bad"))


@registered("SELECT CAST(user_id AS VARCHAR) AS pk, array_to_string(list_sort(list(DISTINCT event_id % 12)), ',') AS numbers FROM events GROUP BY user_id")
def element_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets of a registered element type sort and compare by that type, here numbers in two bytes; an unknown type is an error."""
    coerce.register_element("short", lambda v: int(v).to_bytes(2, "big"), lambda c: F.conv(F.hex(c), 16, 10).cast("int"))
    try:
        Catalog().add(TableSchema("t", (SchemaColumn("s", "shorter", "orset"),)))
        raise AssertionError("no error")
    except ValueError:
        pass
    t = Database.open(spark, workspace(spark), schemas=[TableSchema("numbers", (SchemaColumn("numbers", "short", "orset"),))]).table("numbers")
    o = ops(spark, sf_dir)
    t.merge({"orset": o.select("pk", F.lit("numbers").alias("col"), F.unhex(F.lpad(F.hex(F.col("event_id") % 12), 4, "0")).alias("elem"), F.col("event_id").cast("string").alias("tag"))})
    return t.wide().select("pk", F.array_join(F.transform("numbers", lambda x: x.cast("string")), ",").alias("numbers"))


# Keys and messages.


@registered("SELECT n_name AS key, 'nation ' || n_nationkey AS value FROM nation WHERE n_regionkey NOT IN (1, 2) AND n_name >= 'A' UNION ALL SELECT n_name, 'again' FROM nation WHERE n_nationkey = (SELECT min(n_nationkey) FROM nation WHERE n_regionkey = 2)")
def key_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys set for good, for a time that is over, deleted, and set again."""
    store = KeyValue(Database.open(spark, workspace(spark)))
    rows = _table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()
    gone = [r["n_name"] for r in rows if r["n_regionkey"] == 2]
    with store.db.update():
        for r in rows:
            store.set(r["n_name"], f"nation {r['n_nationkey']}".encode(), 10 if r["n_regionkey"] == 1 else 0, now_millis=1000)
        for key in gone:
            store.delete(key)
        store.set(gone[0], b"again")
    assert store.get(gone[0]) == b"again" and store.get(gone[1]) is None and store.get("no key") is None
    return store.scan(now_millis=12_000, desc=True).select("key", F.decode("value", "utf-8").alias("value"))


@registered(_values([("b", "heartbeat", "a"), ("c", "heartbeat", "a"), ("b", "raw_delta", "a"), ("a", "gc_prepare_ack", "b")], "node, kind, sender"))
def transport(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A message to one node, one to all, and another tenant that sees neither."""
    at = workspace(spark)
    boxes = {n: Mailbox(spark, at, "t", n) for n in "abc"} | {"x": Mailbox(spark, at, "other", "b")}
    boxes["a"].broadcast("heartbeat", clock=5)
    boxes["a"].send("b", "raw_delta", tbl="users", pk="p", columns=["c"], payload=b"1")
    boxes["b"].send("a", "gc_prepare_ack", success=True)
    return lattice.union([b.received().select(F.lit(n).alias("node"), "kind", "sender") for n, b in boxes.items()])


@registered(f"SELECT {_pk_sql('user_id')} AS pk, CAST(count(*) AS VARCHAR) AS payload, 'whole' AS first_try, 'partial' AS second_try FROM events GROUP BY user_id")
def fetch_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request whose answer comes in parts; one that never ends is an error and not a shorter answer."""
    at = workspace(spark)
    asker, server = Mailbox(spark, at, "t", "a"), Mailbox(spark, at, "t", "b")
    counts = _events(spark, sf_dir).groupBy(pk_of(F.col("user_id")).alias("pk")).count().collect()
    parts = [{"tbl": "users", "pk": r["pk"], "payload": str(r["count"]).encode()} for r in counts]
    first, second = (asker.send("b", "fetch_raw_request", tbl="users") for _ in range(2))
    server.answer(first, "a", "fetch_raw_response", parts)
    server.answer(second, "a", "fetch_raw_response", parts[1:], ended=False)
    try:
        asker.collect(second, 0.5)
        ended = "whole"
    except PartialAnswer:
        ended = "partial"
    return asker.collect(first).select("pk", F.decode("payload", "utf-8").alias("payload"), F.lit("whole").alias("first_try"), F.lit(ended).alias("second_try"))

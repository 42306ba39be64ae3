"""What databases write, read and log; and the registered queries that go through them."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from meldframe import engine_queries
from meldframe.functions import coerce
from meldframe.operators import lattice, sync
from meldframe.plans.schema import Column, Index, TableSchema
from meldframe.sources import database
from meldframe.sources.database import Atoms, Database, FloorMismatch
from meldframe.sources.files import read_all
from meldframe.sources.folder import Folder
from meldframe.streaming import feed

from .test_queries import DATA, plain

PK = "01890a5d-ac96-774b-bcce-b302099a8057"
NOTES = TableSchema("notes", (Column("title"), Column("tags", "int", "orset"), Column("count", "int", "counter"), Column("list", crdt="rga")), (Index("by_title", ("title",)),))


def pks(n):
    return [f"01890a5d-ac96-774b-bcce-{i:012x}" for i in range(n)]


def titles(spark, n, ts=1):
    return spark.createDataFrame([(p, "title", ts, f"t{i}".encode()) for i, p in enumerate(pks(n))], lattice.STATES["lww"])


def size_of(at):
    return {str(p): p.stat().st_size for p in Path(at).rglob("*.parquet") if p.is_file()}


def test_commits_append(spark, tmp_path):
    db = Database.open(spark, str(tmp_path / "db"), schemas=[NOTES])
    t = db.table("notes")
    t.merge({"lww": titles(spark, 20_000)})
    before = size_of(tmp_path / "db/state")
    t.set(pks(3)[2], {"title": "new"})
    after = size_of(tmp_path / "db/state")
    new = {k: v for k, v in after.items() if k not in before}
    assert {k: after[k] for k in before} == before and sum(new.values()) < 5_000 < sum(before.values())
    assert t.get(pks(3)[2])["title"] == "new" and t.wide().count() == 20_000


def test_point_get_is_pushed_down(spark, tmp_path):
    db = Database.open(spark, str(tmp_path / "db"), schemas=[NOTES])
    t = db.table("notes")
    t.merge({"lww": titles(spark, 100)})
    t.add(PK, "tags", 3)
    t.add(PK, "list", "x")
    t.set(PK, {"title": "x"})
    plan = t.wide(PK)._jdf.queryExecution().executedPlan().toString()
    scans = re.findall(r"FileScan parquet.*", plan)
    assert len(scans) >= 4 and all(f"EqualTo(pk,{PK})" in s for s in scans)
    assert t.get(PK) == {"title": "x", "tags": [3], "list": ["x"]}


def test_levels(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(database, "FAN", 3)
    db = Database.open(spark, str(tmp_path / "db"), schemas=[NOTES])
    t = db.table("notes")
    for i in range(10):
        t.set(pks(2)[i % 2], {"title": f"v{i}"})
    parts = db._version("notes")["notes/lww"]
    assert sorted(database._level(p) for p in parts) == [0, 2] and {r["title"] for r in t.wide().collect()} == {"v8", "v9"}
    db.compact()
    assert len(db._version("notes")["notes/lww"]) == 1 and {r["title"] for r in t.wide().collect()} == {"v8", "v9"}
    assert len(Folder(spark, str(tmp_path / "db")).names("state/notes")) == 1


def test_clock_log_and_listeners(spark, tmp_path):
    db = Database.open(spark, str(tmp_path / "db"), schemas=[NOTES])
    t, heard = db.table("notes"), []
    db.listeners.append(lambda log: heard.append(log.count()))
    ahead = db.clock.now() + (10**7 << 16)
    t.merge({"lww": titles(spark, 3, ahead)}, peer="b")
    t.set(pks(1)[0], {"title": "mine"})
    assert t.get(pks(1)[0])["title"] == "mine" and db.clock.now() > ahead and heard == [3, 1]
    again = Database.open(spark, str(tmp_path / "db"))
    assert again.clock.now() > ahead and again.sequence == 2
    seen = feed.changes(again.log(), ["notes"]).collect()
    assert sorted((r["seq"], r["source"]) for r in seen) == [(1, "b")] * 3 + [(2, db.replica)]
    own = again.log().where("seq = 2").first()
    assert bytes(own["value"]) == b"mine" and own["kind"] == "lww"


def test_counters_within_one_commit(spark, tmp_path):
    db = Database.open(spark, str(tmp_path / "db"), schemas=[NOTES])
    t = db.table("notes")
    with db.update():
        for _ in range(3):
            t.add(PK, "count", 2)
        t.remove(PK, "count", 1)
    assert t.row(PK).get_int("count") == 5
    t.set(PK, {"count": Atoms("counter", (("other", 4, 0),))})
    assert t.row(PK).get_int("count") == 9
    with pytest.raises(ValueError):
        t.set(PK, {"count": Atoms("lww", ((1, b"x"),))})


def test_floors_and_kinds_on_merge(spark, tmp_path):
    t = Database.open(spark, str(tmp_path / "db"), schemas=[NOTES]).table("notes")
    t.db.gc(50)
    one = {"lww": titles(spark, 1)}
    for floor, full in ((40, True), (60, False)):
        with pytest.raises(FloorMismatch):
            t.merge(one, peer_floor=floor, full=full)
    t.merge(one, peer_floor=60, full=True)
    assert t.db.gc_floor == 60
    with pytest.raises(ValueError, match="two types"):
        t.merge({"counter": spark.createDataFrame([(PK, "title", "n", 1, 0)], lattice.STATES["counter"])})
    assert [sync.floor_action(*x) for x in ((0, 0), (-1, 0), (5, 5), (6, 5), (5, 6))] == ["pass", "pass", "pass", "full_sync", "block"]


def test_row_view(spark, tmp_path):
    t = Database.open(spark, str(tmp_path / "db"), schemas=[NOTES]).table("notes")
    with t.db.update():
        t.set(PK, {"title": "x", "extra": "undeclared"})
        t.add(PK, "tags", 10)
        t.add(PK, "tags", 9)
    r = t.row(PK)
    assert r.get_string("title") == "x" and r.get_string("extra") == "undeclared" and r.get_list("tags") == [9, 10] and r.contains("tags", 9)
    assert r.get_int("title") is None and not r.has("list") and r.get_list("list") == [] and r.get_file("title") is None


def test_folder(spark, tmp_path):
    f = Folder(spark, str(tmp_path / "a+(b) c"))
    f.write_text("x/t.json", "é1")
    f.write_text("x/t.json", "é2")
    assert f.read_text("x/t.json") == "é2" and f.names("x") == ["t.json"] and f.names("none") == [] and f.files() == ["x/t.json"]
    f.write_text("u", "1")
    with pytest.raises(Exception, match="exist"):
        f.move("u", "x/t.json")
    other = f.sub("copy")
    f.sub("x").copy_files("", other)
    assert other.files() == ["t.json"]
    assert {r["path"] for r in read_all(spark, f.at("x")).collect()} == {"t.json"}
    f.remove()
    assert not f.exists()


def test_numbers_end_where_the_text_does(spark):
    d = spark.createDataFrame([("7",), ("7\n",), ("1.5\n",), ("\n7",)], "s string").select(coerce.int_like(F.col("s"), "string"), coerce.float_like(F.col("s"), "string"))
    assert [tuple(r) for r in d.collect()] == [(7, 7.0), (None, None), (None, None), (None, None)]
    for bad in ("7\n", "\n7"):
        with pytest.raises(ValueError):
            coerce.literal(bad, "int")


def test_chunks_that_come_wrong(spark):
    import hashlib

    data = bytes(range(256)) * 40
    rows = [("f", i, 20, data[512 * i : 512 * i + 512], len(data), hashlib.sha256(data).hexdigest()) for i in range(20)]
    frame = lambda r: spark.createDataFrame(r, "path string, chunk int, chunks int, bytes binary, size long, hash string")
    assert bytes(sync.assembled(frame(rows[::-1] + rows[:3])).first()["content"]) == data
    for wrong in (rows[1:], [*rows[:-1], (*rows[-1][:3], b"x" * 512, *rows[-1][4:])]):
        with pytest.raises(Exception, match="broken"):
            sync.assembled(frame(wrong)).collect()
    with pytest.raises(Exception, match="unknown kind"):
        sync.messages(spark.createDataFrame([("gossip",)], "kind string")).collect()


@pytest.mark.skipif(not DATA.exists(), reason="no test data here")
@pytest.mark.parametrize("name", ["point_get", "merge_raw_rows", "rga_insert", "gc_database", "manual_gc_handlers", "hlc_now_update", "file_reassembly", "observed_feed", "stream_merge_sets", "path_validation", "index_maintained"])
def test_engine_queries(spark, name):
    """Some of the registered queries; the driver runs all of them."""
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    mine = engine_queries.QUERIES[name](spark, str(DATA))
    order = sorted(mine.columns)
    got = sorted(tuple(plain(r[c]) for c in order) for r in mine.collect())
    cur = con.execute(engine_queries.ORACLE_SQL[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == order
    assert got == sorted(tuple(plain(r[columns.index(c)]) for c in order) for r in cur.fetchall())

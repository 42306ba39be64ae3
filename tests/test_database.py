import pytest
from pyspark.sql import functions as F

from meldframe.plans.query import Condition, Query, select_plan
from meldframe.plans.schema import Catalog, Column, Index, TableSchema, checked
from meldframe.sources.database import Database, FileImport, Tenants, restore, stored_bytes
from meldframe.sources.files import checked_path, is_bad_path, read_all, read_at
from meldframe.streaming import feed

PK = "01890a5d-ac96-774b-bcce-b302099a8057"
PK2 = "01890a5d-ac96-774b-bcce-b302099a8058"
PRODUCTS = TableSchema("products", (Column("title"), Column("price", "int"), Column("views", crdt="counter"), Column("tags", crdt="orset"), Column("comments", crdt="rga"), Column("avatar", crdt="file")), (Index("price", ("price",)),))


def test_plans():
    s = TableSchema("t", tuple(Column(c) for c in "abc"), (Index("a", ("a",)), Index("ab", ("a", "b")), Index("c", ("c",))))
    c = lambda f, op: Condition(f, op, "x")
    assert select_plan(s, [c("a", "="), c("b", "=")]).index.name == "ab"
    assert select_plan(s, [c("a", "="), c("b", ">")]).score == 15
    assert select_plan(s, [c("a", "=")]).index.name == "a"
    assert select_plan(s, [c("c", "<")]).ranged == "c"
    assert select_plan(s, [c("a", "IN"), c("b", "!=")]).index is None


@pytest.mark.parametrize("t", [
    TableSchema(" "), TableSchema("t", (Column("a"), Column(" a"))), TableSchema("t", (Column("a", "json"),)), TableSchema("t", (Column("a", crdt="tree"),)),
    TableSchema("t", (), (Index("i", ()),)), TableSchema("t", (Column("s", crdt="orset"),), (Index("i", ("s",)),)), TableSchema("t", (), (Index("i", ("a",), id=1), Index("j", ("a",), id=1))),
])
def test_bad_schemas(t):
    with pytest.raises(ValueError):
        checked(t)


def test_catalog():
    c = Catalog()
    assert c.add(PRODUCTS).id == 1 and c.add(PRODUCTS).id == 1 and c.add(TableSchema("u")).id == 2
    with pytest.raises(ValueError, match="otherwise"):
        c.add(TableSchema("products"))
    assert Catalog.from_json(c.to_json()) == c and c.by_id(2).name == "u" and c.names() == ["products", "u"]


def test_query(spark):
    rows = [("1", "US", 30, "Alice"), ("2", "US", 15, "Bob"), ("3", "EU", 30, "Charlie"), ("4", "US", 40, "David"), ("5", "US", None, "Eve")]
    s = TableSchema("users", (Column("region"), Column("age", "int"), Column("name")), (Index("ra", ("region", "age")), Index("n", ("name",))))
    q = Query(spark.createDataFrame(rows, "pk string, region string, age long, name string"), s)
    names = lambda x: [r["name"] for r in x.find().collect()]
    assert sorted(names(q.where("region", "=", "US").and_("age", ">", "20"))) == ["Alice", "David"]
    assert names(q.where("age", "!=", 30).order_by("age")) == ["Bob", "David"]
    assert names(q.where("age", "IN", ["15", 40]).order_by("age", True)) == ["David", "Bob"]
    assert names(q.where("nothing", "!=", 1)) == [] and len(names(q.limit(0))) == 5
    assert names(q.ordered("index").where("name", ">", "B").order_by(None, True).offset(1).limit(2)) == ["David", "Eve"]
    with pytest.raises(ValueError, match="normalize"):
        q.where("age", ">", object()).where("age", "=", 1).find()


def test_writes_and_reads(spark, tmp_path):
    db = Database.open(spark, str(tmp_path / "db"), schemas=[PRODUCTS])
    t = db.table("products")
    with db.update():
        t.set(PK, {"title": "pen", "price": 20.7, "views": 3})
        t.add(PK, "views", 4)
        for x in ("red", "blue", "red"):
            t.add(PK, "tags", x)
        for x in "ABC":
            t.add(PK, "comments", x)
        t.insert_after(PK, "comments", "A", "a")
        t.insert_at(PK, "comments", 0, "first")
        t.remove_at(PK, "comments", 3)
        t.remove(PK, "tags", "red")
    got = t.get(PK)
    assert got["title"] == "pen" and got["price"] == 20 and got["views"] == 7 and got["tags"] == ["blue"] and got["comments"] == ["first", "A", "a", "C"]
    with pytest.raises(KeyError):
        t.get(PK2)
    with pytest.raises(ValueError):
        t.remove(PK, "title", "x")
    with pytest.raises(ValueError):
        t.set("1-2", {"title": "x"})
    with pytest.raises(IndexError):
        t.insert_at(PK, "comments", 9, "x")
    root = t.merkle().where("level = 0").first()["hash"]
    other = Database.open(spark, str(tmp_path / "other"), schemas=[PRODUCTS])
    other.table("products").set(PK2, {"title": "ink"})
    other.table("products").merge({k: d for k, d in t.get_states(PK).items()})
    assert other.table("products").get(PK) == got
    assert other.table("products").digests().where(F.col("pk") == PK).first()["digest"] == t.digests().first()["digest"]
    assert len(root) == 64
    assert db.gc(db.clock.now())["tombstone"] == 2 and db.gc_floor > 0 and t.get(PK)["tags"] == ["blue"]
    again = Database.open(spark, str(tmp_path / "db"))
    assert again.table("products").get(PK) == t.get(PK) and again.replica == db.replica
    with pytest.raises(ValueError):
        Database.open(spark, str(tmp_path / "db"), tenant="another")


def test_rollback_and_backup(spark, tmp_path):
    db = Database.open(spark, str(tmp_path / "db"), schemas=[PRODUCTS])
    t = db.table("products")
    (tmp_path / "in.bin").write_bytes(b"0123456789")
    t.set(PK, {"avatar": FileImport(str(tmp_path / "in.bin"), "a/x.bin")})
    with pytest.raises(RuntimeError), db.update():
        t.set(PK, {"title": "lost", "avatar": FileImport(str(tmp_path / "in.bin"), "b.bin")})
        raise RuntimeError
    assert "title" not in t.get(PK) and not (tmp_path / "db/files/b.bin").exists()
    files = read_all(spark, str(tmp_path / "db/files"))
    assert t.get(PK)["avatar"]["hash"] == files.first()["hash"]
    assert bytes(read_at(files, 8, 5).first()["bytes"]) == b"89" and read_at(files, 10, 1).count() == 0
    with pytest.raises(ValueError):
        read_at(files, -1, 5)
    first = db.backup(str(tmp_path / "full"))
    t.set(PK, {"title": "kept"})
    db.backup(str(tmp_path / "more"), first)
    restore([str(tmp_path / "full"), str(tmp_path / "more")], str(tmp_path / "back"))
    assert Database.open(spark, str(tmp_path / "back")).table("products").get(PK)["title"] == "kept"
    with pytest.raises(FileExistsError):
        restore([str(tmp_path / "full")], str(tmp_path / "back"))
    with pytest.raises(ValueError):
        restore([], "..")
    tenants = Tenants(spark, str(tmp_path / "all"))
    tenants.get("é/1").define(PRODUCTS)
    tenants.backup(str(tmp_path / "zip"))
    Tenants(spark, str(tmp_path / "all2")).restore(str(tmp_path / "zip"))
    assert Tenants(spark, str(tmp_path / "all2")).names() == ["é/1"]


@pytest.mark.parametrize(("path", "ok"), [("a/b", True), (" a\\b ", True), ("a/../b", True), ("", False), ("/a", False), ("..", False), ("a/../../b", False), ("c:x", False), (".", False)])
def test_paths(spark, path, ok):
    if ok:
        checked_path(path)
    else:
        with pytest.raises(ValueError):
            checked_path(path)
    assert spark.createDataFrame([(path,)], "p string").select(is_bad_path(F.col("p"))).first()[0] is not ok


def test_stored_bytes():
    assert [stored_bytes(*x) for x in ((2.0, "float"), (True, "bool"), ("5", "int"), (b"\xff", "bytes"), ("2024-01-02T03:04:05.5Z", "timestamp"))] == [b"2", b"true", b"5", b"\xff", b"2024-01-02T03:04:05.5Z"]


def test_stream(spark, tmp_path):
    log = str(tmp_path / "log")
    empty = spark.createDataFrame([], feed.OPLOG)
    names = empty.columns

    def write(rows):
        full = [tuple(r.get(c) for c in names) for r in rows]
        spark.createDataFrame(full, feed.OPLOG).write.mode("append").parquet(log)

    write([{"seq": i, "tbl": "t", "pk": "p", "col": "c", "kind": "lww", "ts": i % 4, "value": str(i).encode(), "source": "a"} for i in range(8)])
    versions = []

    def put(df):
        at = str(tmp_path / f"v{len(versions)}")
        df.write.parquet(at)
        versions.append(at)

    read = lambda: spark.read.parquet(versions[-1]) if versions else None
    for _ in range(2):
        feed.merge_stream(feed.read_log(spark, log), "lww", read, put, str(tmp_path / "cp")).awaitTermination(60)
        write([{"seq": 9, "tbl": "t", "pk": "p", "col": "c", "kind": "lww", "ts": 1, "value": b"late", "source": "b"}])
    assert [(r["ts"], bytes(r["value"])) for r in read().collect()] == [(3, b"3")] and len(versions) == 2
    changed = feed.changes(spark.read.parquet(log), ["t"], ["c"], True, "b")
    assert feed.wait_for_change(lambda: changed, 3, 1)["seq"] == 9 and feed.wait_for_change(lambda: changed, 9, 0.3, 0.1) is None

import random

import pytest
from pyspark.sql import functions as F

from meldframe.operators import digest, gc, lattice, rga, sync

ROWS = {
    "lww": [("p", "c", ts, v) for ts in (1, 2) for v in (b"10", b"9", b"a")] + [("q", "c", 5, None), ("q", "d", 1, b"")],
    "counter": [("p", "n", r, i, i // 2) for r in "ab" for i in range(5)],
    "file": [("p", "f", 3, "x", "h1", 4), ("p", "f", 3, "a", "h2", 9), ("p", "f", 1, "z", "h", 1)],
    "rga": [("p", "l", str(i), b"v", "" if i < 3 else str(i - 3), i, bool(i % 2) and flag, 10 * (i % 3) if flag else 0) for i in range(9) for flag in (True, False)],
    "tombstone": [("p", "s", str(i % 4), i) for i in range(9)],
}


@pytest.mark.parametrize("kind", sorted(ROWS))
def test_merge_laws(spark, kind):
    """Any order, grouping and repetition of replicas' atoms gives the same state."""
    rng, rows = random.Random(3), ROWS[kind]
    frame = lambda r: spark.createDataFrame(r, lattice.STATES[kind])
    state = lambda d: sorted(map(str, d.select(*sorted(d.columns)).collect()))
    merge = lattice.MERGES[kind]
    whole = state(merge(frame(rows)))
    for _ in range(2):
        shuffled = rng.sample(rows, len(rows)) + rng.sample(rows, len(rows) // 2)
        cut = rng.randrange(1, len(shuffled))
        parts = [merge(frame(shuffled[:cut])), merge(frame(shuffled[cut:]))]
        assert state(merge(lattice.union(parts))) == whole
        assert state(merge(lattice.union([merge(lattice.union(parts)), parts[0]]))) == whole


def test_lww_tie_is_bytewise(spark):
    (row,) = lattice.merge_lww(spark.createDataFrame(ROWS["lww"][:6], lattice.STATES["lww"])).collect()
    assert (row["ts"], bytes(row["value"])) == (2, b"10")


def test_sets(spark):
    tags = spark.createDataFrame([("p", "s", b"x", "1"), ("p", "s", b"x", "2"), ("p", "s", b"y", "3")], lattice.STATES["orset"])
    dead = spark.createDataFrame([("p", "s", "1", 5), ("p", "s", "3", 50)], lattice.STATES["tombstone"])
    live = lattice.merge_orset(tags, dead)
    assert [bytes(r["elem"]) for r in lattice.orset_elements(live).collect()] == [b"x"]
    left, graves = lattice.gc_orset(tags, dead, 10)
    assert sorted(r["tag"] for r in left.collect()) == ["2", "3"] and [r["tag"] for r in graves.collect()] == ["3"]
    assert [bytes(r["elem"]) for r in lattice.merge_orset(left, graves).select("elem").distinct().collect()] == [b"x"]
    # a tag that another replica still has comes back once its tombstone is gone
    assert lattice.merge_orset(lattice.union([left, tags]), graves).count() == 2


def brute(vertices):
    """Lists by recursion: (id, origin, ts)."""
    def below(origin):
        for v in sorted((v for v in vertices if v[1] == origin), key=lambda v: (-v[2], [-ord(c) for c in v[0]])):
            yield v[0]
            yield from below(v[0])

    return list(below(""))


def test_list_order(spark):
    rng = random.Random(1)
    vs = [(f"{i:03d}", "" if not i or rng.random() < 0.1 else f"{rng.randrange(i):03d}", rng.randrange(5) + i // 3) for i in range(120)]
    rows = [("p", "l", i, b"v", o, t, False, 0) for i, o, t in vs] + [("q", "l", "a", b"v", "gone", 1, False, 0), ("q", "l", "b", b"w", "", 1, True, 3)]
    linear = rga.linearize(spark.createDataFrame(rows, lattice.STATES["rga"])).collect()
    assert [r["id"] for r in sorted((r for r in linear if r["pk"] == "p"), key=lambda r: r["pos"])] == brute(vs)
    assert [r["id"] for r in sorted((r for r in linear if r["pk"] == "q"), key=lambda r: r["pos"])] == ["b", "a"]


def test_long_list_and_batches(spark):
    n = 3000
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    d = spark.range(n).selectExpr("'p' pk", "'l' col", "lpad(id, 5, '0') id", "cast('v' as binary) value", "if(id = 0, '', lpad(id - 1, 5, '0')) origin", "id ts", "false deleted", "0L deleted_at")
    assert rga.linearize(d).where("cast(id as long) = pos").count() == n
    assert rga.linearize(d.limit(0)).count() == 0


def test_list_gc_takes_old_leaves_only(spark):
    rows = [("p", "l", "a", b"v", "", 1, True, 5), ("p", "l", "b", b"v", "a", 2, True, 5), ("p", "l", "c", b"v", "", 3, True, 0), ("p", "l", "d", b"v", "", 3, True, 50)]
    left = lattice.gc_rga(spark.createDataFrame(rows, lattice.STATES["rga"]), 10)
    assert sorted(r["id"] for r in left.collect()) == ["a", "c", "d"]


def test_type_conflict(spark):
    parts = {"lww": spark.createDataFrame([("p", "c", 1, b"x")], lattice.STATES["lww"]), "counter": spark.createDataFrame([("p", "c", "n", 1, 0)], lattice.STATES["counter"])}
    assert lattice.conflicts(parts).count() == 1


def test_merkle(spark):
    rows = spark.range(300).selectExpr("md5(cast(id as string)) key", "sha2(cast(id as string), 256) digest")
    tree = digest.tree(rows).cache()
    assert digest.root(tree) and digest.root(tree.limit(0)) == ""
    assert digest.children(tree, "").count() == 16
    other = rows.where(F.col("key") != rows.first()["key"])
    diff = digest.tree_diff(tree, digest.tree(other))
    assert diff.count() == 5 and digest.rows_to_send(rows, other, diff).count() == 1 and digest.rows_to_send(other, rows, diff).count() == 0


def test_agreement():
    ran = []
    members = [gc.Member(lambda s=s: s, ran.append) for s in (50, 40, 60)]
    assert gc.agree(members[0], members[1:], "r1") == 40 and ran == [40, 40, 40] and all(m.floor == 40 for m in members)
    falling = iter([30, 30, 10, 10])
    bad = gc.Member(lambda: next(falling), ran.append)
    with pytest.raises(ValueError, match="fell"):
        gc.agree(members[0], [bad], "r2")
    assert len(ran) == 3 and not members[0].pending and not bad.pending
    for args in (("", 5), ("r", 0), ("r", 100)):
        with pytest.raises(ValueError):
            members[0].prepare(*args)
    with pytest.raises(ValueError):
        members[0].commit("unknown", 5)
    assert gc.raised_floor(9, 3) == 9 and gc.raised_floor(9, 0) == 9 and gc.raised_floor(9, 12) == 12


def test_sync_rules(spark):
    d = spark.createDataFrame([(0, 0), (60_000, 0), (10, 5001), (10, 5000)], "away long, lag long")
    assert [r[0] for r in d.select(sync.rejoin(F.col("away"), F.col("lag"))).collect()] == ["clock_update", "full_sync", "full_sync", "clock_update"]
    sizes = spark.createDataFrame([(0,), (8 << 20,), ((8 << 20) + 1,)], "size long")
    assert [r[0] for r in sizes.select(sync.chunk_count(F.col("size"))).collect()] == [1, 1, 9]
    twice = spark.createDataFrame([("a", "h", 1), ("a", "g", 1)], "path string, hash string, size long")
    with pytest.raises(Exception, match="conflicting"):
        sync.file_metadata(twice).collect()
    assert len(sync.MESSAGES) == 21

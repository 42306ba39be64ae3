import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from meldframe.functions import coerce, hlc
from meldframe.functions.hlc import Clock
from meldframe.operators.gc import safe_by_offset


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(-5, 2**48), st.integers(0, 2**40)), min_size=1, max_size=20))
def test_clock_only_rises(steps):
    at = [0]
    clock = Clock(lambda: at[0])
    last = -1
    for millis, seen in steps:
        at[0] = millis
        now = clock.update(seen) if seen % 2 else clock.now()
        assert now > last and (not seen % 2 or now > seen)
        last = now


def test_pack_saturates(spark):
    c = F.col("id")
    d = spark.range(1).select(
        hlc.pack(F.lit(-5), F.lit(7)).alias("low"), hlc.pack(F.lit(2**60), F.lit(1)).alias("high"),
        hlc.sub_physical(hlc.pack(F.lit(10), F.lit(3)), 20).alias("sub"), hlc.add_physical(hlc.pack(F.lit(10), F.lit(3)), 5).alias("add"), c,
    ).first()
    assert d["low"] == 7 and d["high"] == (hlc.MAX_PHYSICAL << 16) + 1 and d["sub"] == 3 and d["add"] == (15 << 16) + 3


def test_offset():
    now = (100_000 << 16) + 9
    assert safe_by_offset(now, 0) == now and safe_by_offset(now, 30_000) == (70_000 << 16) + 9 and safe_by_offset(now, 10**9) == 9


@pytest.mark.parametrize(
    ("value", "kind", "to"),
    [(20.7, "int", 20), ("-5", "int", -5), (-3.9, "int", -3), ("1.5", "float", 1.5), ("True", "bool", True), ("f", "bool", False), (7, "string", "7"), ("x", "bytes", b"x")],
)
def test_literals(value, kind, to):
    assert coerce.literal(value, kind) == to


@pytest.mark.parametrize(("value", "kind"), [(" 7 ", "int"), ("1.5", "int"), ("NaN", "float"), (float("nan"), "float"), ("yes", "bool"), ("noon", "timestamp"), (None, "int"), (object(), "string")])
def test_bad_literals(value, kind):
    with pytest.raises(ValueError, match="normalize condition"):
        coerce.literal(value, kind)


def test_epoch_units():
    assert len({coerce.literal(1_700_000_000 * u, "timestamp") for u in (1, 10**3, 10**6, 10**9)}) == 1


def test_stored_and_loaded(spark):
    d = spark.sql("select 10L i, 2.0D f, true b, timestamp'2024-01-02 03:04:05.678' t, 'é' s")
    kinds = {"i": "int", "f": "float", "b": "bool", "t": "timestamp", "s": "string"}
    row = d.select(*(F.decode(coerce.stored(F.col(c), k), "utf-8").alias(c) for c, k in kinds.items())).first()
    assert tuple(row) == ("10", "2", "true", "2024-01-02T03:04:05.678Z", "é")
    back = d.select(*(coerce.loaded(coerce.stored(F.col(c), k), k).alias(c) for c, k in kinds.items())).first()
    assert tuple(back) == tuple(d.first())

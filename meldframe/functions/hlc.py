"""Hybrid logical clocks: one BIGINT of 48 bits of milliseconds and 16 of a counter. Column functions, and a clock for the driver."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

LOGICAL_BITS = 16
MAX_LOGICAL = (1 << LOGICAL_BITS) - 1
MAX_PHYSICAL = (1 << 47) - 1


def pack(millis: Column, logical: Column) -> Column:
    """The timestamp of these milliseconds, held between 0 and the greatest that fits, and counter."""
    held = F.least(F.greatest(millis.cast("long"), F.lit(0)), F.lit(MAX_PHYSICAL))
    return F.shiftleft(held, LOGICAL_BITS).bitwiseOR(logical.cast("long").bitwiseAND(MAX_LOGICAL))


def physical(ts: Column) -> Column:
    return F.shiftright(ts, LOGICAL_BITS)


def logical(ts: Column) -> Column:
    """The counter as an unsigned number; the reference gives negative ones from 32768."""
    return ts.bitwiseAND(MAX_LOGICAL)


def add_physical(ts: Column, millis: Column | int) -> Column:
    """ts moved by so many milliseconds, which may be negative, with its counter; stops at either end of the range."""
    by = F.lit(millis) if isinstance(millis, int) else millis
    return pack(physical(ts) + by, logical(ts))


def sub_physical(ts: Column, millis: Column | int) -> Column:
    return add_physical(ts, -millis)


def physical_diff(a: Column, b: Column) -> Column:
    return physical(a) - physical(b)


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1 by milliseconds, then counter."""
    return F.when(a < b, -1).when(a > b, 1).otherwise(0)


def is_stale(local: Column, remote: Column, most_millis: int) -> Column:
    """Whether remote lags behind local by more than so many milliseconds."""
    return physical_diff(local, remote) > most_millis


def of_timestamp(ts: Column, logical_part: Column) -> Column:
    """The clock value of a timestamp, milliseconds rounded down."""
    return pack(F.unix_millis(ts.cast("timestamp")), logical_part)


class Clock:
    """A clock on the driver. Every value is greater than all before, and than all that update() was told of."""

    def __init__(self, millis: Callable[[], int] | None = None, start: int = 0) -> None:
        self._millis = millis or (lambda: time.time_ns() // 1_000_000)
        self._last, self._lock = start, threading.Lock()

    def now(self) -> int:
        with self._lock:
            return self._step(self._last)

    def update(self, seen: int) -> int:
        """After a value from elsewhere."""
        with self._lock:
            return self._step(max(self._last, seen))

    def _step(self, least: int) -> int:
        self._last = max(min(max(self._millis(), 0), MAX_PHYSICAL) << LOGICAL_BITS, least + 1)
        return self._last

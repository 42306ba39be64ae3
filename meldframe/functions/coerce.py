"""The six logical types: how values are coerced to them, stored as bytes, and read back. Column expressions, and the same for literals."""

from __future__ import annotations

import datetime as dt
import math
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Logical types and what Spark has for them.
SPARK_TYPES = {"string": "string", "bytes": "binary", "int": "bigint", "float": "double", "bool": "boolean", "timestamp": "timestamp"}
# Texts that are read as booleans.
TRUE_TEXTS = ["1", "t", "T", "TRUE", "true", "True"]
FALSE_TEXTS = ["0", "f", "F", "FALSE", "false", "False"]
_INT = r"^[+-]?[0-9]+\z"
_FLOAT = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\z"
_EPOCH_UNITS = [(10**18, 1_000_000_000), (10**15, 1_000_000), (10**12, 1_000)]


def int_like(c: Column, kind: str) -> Column:
    """kind: the column's Spark type. Floats are cut toward zero; text must be a decimal number; the rest is null."""
    if kind == "string":
        return F.when(c.rlike(_INT), c).try_cast("bigint")
    if kind in ("double", "float"):
        whole = F.when(c >= 0, F.floor(c)).otherwise(F.ceil(c))
        return F.when(F.abs(c) < 2.0**63, whole).try_cast("bigint")
    return c.try_cast("bigint")


def float_like(c: Column, kind: str) -> Column:
    """Finite numbers only; NaN is null here, as it compares with nothing."""
    value = F.when(c.rlike(_FLOAT), c).try_cast("double") if kind == "string" else c.try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < math.inf), value)


def bool_like(c: Column, kind: str) -> Column:
    if kind == "boolean":
        return c
    return F.when(c.isin(TRUE_TEXTS), True).when(c.isin(FALSE_TEXTS), False)


def epoch_like(c: Column) -> Column:
    """Timestamp of a number since 1970, its unit told by its size: ns, us, ms or s. Parts of a microsecond are cut off downward."""
    n, exact = c.cast("decimal(38,6)"), None
    for least, per_second in [*_EPOCH_UNITS, (0, 1)]:
        micros = n / (per_second // 1_000_000) if per_second > 1_000_000 else n * (1_000_000 // per_second)
        exact = F.when(F.abs(n) >= least, F.floor(micros)) if exact is None else exact.when(F.abs(n) >= least, F.floor(micros))
    return F.timestamp_micros(exact.cast("bigint"))


def timestamp_like(c: Column, kind: str) -> Column:
    if kind == "string":
        return c.try_cast("timestamp")
    return epoch_like(c) if kind in ("bigint", "int", "double", "float") else c.cast("timestamp")


def coerced(c: Column, kind: str, to: str) -> Column:
    if to == "int":
        return int_like(c, kind)
    if to == "float":
        return float_like(c, kind)
    if to == "bool":
        return bool_like(c, kind)
    if to == "timestamp":
        return timestamp_like(c, kind)
    if to == "bytes":
        return c if kind == "binary" else F.encode(c, "utf-8")
    return F.decode(c, "utf-8") if kind == "binary" else c.cast("string")


def stored(c: Column, to: str) -> Column:
    """A typed value's bytes, by which ties between replicas are decided: decimal text, shortest float text, true or false, UTC text."""
    if to == "bytes":
        return c
    if to == "float":
        text = F.regexp_replace(c.cast("string"), r"\.0$", "")
    elif to == "timestamp":
        text = F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.regexp_replace(F.date_format(c, ".SSSSSS"), r"\.?0+$", ""), F.lit("Z"))
    else:
        text = c.cast("string")
    return F.encode(text, "utf-8")


@dataclass(frozen=True)
class ElementType:
    """A type of elements of sets and lists beside the six: how Python values become bytes, and bytes a column."""

    to_bytes: Callable[[object], bytes]
    from_bytes: Callable[[Column], Column]


#: Element types by the names that schemas use.
ELEMENTS: dict[str, ElementType] = {}


def register_element(name: str, to_bytes: Callable[[object], bytes], from_bytes: Callable[[Column], Column]) -> None:
    if name in SPARK_TYPES:
        raise ValueError(f"{name} is a type already")
    ELEMENTS[name] = ElementType(to_bytes, from_bytes)


def loaded(c: Column, to: str) -> Column:
    """The typed value of stored bytes; null if they aren't one."""
    if to in ELEMENTS:
        return ELEMENTS[to].from_bytes(c)
    return c if to == "bytes" else coerced(F.decode(c, "utf-8"), "string", to)


def literal(value: object, to: str) -> object:
    """A predicate's literal as the column's type. Raises ValueError if it isn't one."""
    bad = ValueError(f"normalize condition: {value!r} is no {to}")
    if value is None:
        raise bad
    if to == "string":
        if isinstance(value, bytes):
            return value.decode("utf-8", "replace")
        if isinstance(value, bool):
            return "true" if value else "false"
        if isinstance(value, str | int | float):
            return str(value)
        raise bad
    if to == "bytes":
        if isinstance(value, str | bytes):
            return value.encode() if isinstance(value, str) else value
        raise bad
    if to == "bool":
        if isinstance(value, bool):
            return value
        if isinstance(value, str) and value in TRUE_TEXTS + FALSE_TEXTS:
            return value in TRUE_TEXTS
        raise bad
    if to == "int":
        if isinstance(value, bool):
            raise bad
        if isinstance(value, float) and math.isfinite(value):
            value = math.trunc(value)
        if isinstance(value, str) and re.fullmatch(_INT[1:-2], value):
            value = int(value)
        if isinstance(value, int) and -(2**63) <= value < 2**63:
            return value
        raise bad
    if to == "float":
        if isinstance(value, str) and re.fullmatch(_FLOAT[1:-2], value):
            value = float(value)
        if not isinstance(value, bool) and isinstance(value, int | float) and math.isfinite(value):
            return float(value)
        raise bad
    if to == "timestamp":
        if isinstance(value, dt.datetime):
            return value if value.tzinfo else value.replace(tzinfo=dt.UTC)
        if isinstance(value, str):
            try:
                at = dt.datetime.fromisoformat(value)
            except ValueError:
                raise bad from None
            return at if at.tzinfo else at.replace(tzinfo=dt.UTC)
        if not isinstance(value, bool) and isinstance(value, int | float) and math.isfinite(value):
            per_second = next((u for least, u in _EPOCH_UNITS if abs(value) >= least), 1)
            return dt.datetime(1970, 1, 1, tzinfo=dt.UTC) + dt.timedelta(microseconds=int(value * 1_000_000 // per_second))
    raise bad

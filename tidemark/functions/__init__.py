"""Column expressions shared by the operators; all of them plan to built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND, MINUTE, HOUR, DAY = 1_000_000, 60_000_000, 3_600_000_000, 86_400_000_000


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def epoch_us(ts: str | Column) -> Column:
    """Microseconds since 1970 of a timestamp without time zone, whatever the session's zone is."""
    t = col(ts)
    seconds = F.hour(t) * 3600 + F.minute(t) * 60
    return F.datediff(t, F.lit("1970-01-01")).cast("long") * DAY + seconds.cast("long") * SECOND + (F.expr(f"extract(second from {ts})") * SECOND).cast("long")


def serial_day(d: str | Column) -> Column:
    """Days since 1899-12-30 as a timestamp, rounded to whole seconds."""
    return F.timestamp_micros((F.round((col(d) - 25569) * 86400) * SECOND).cast("long"))


def tolerant_floor(x: str | Column, eps: float = 1e-5) -> Column:
    return F.floor(col(x) + eps)


def tolerant_ceil(x: str | Column, eps: float = 1e-5) -> Column:
    return F.ceil(col(x) - eps)


def finite(x: str | Column) -> Column:
    """Neither null nor NaN."""
    return col(x).isNotNull() & ~F.isnan(col(x))


def array_mean(x: str | Column) -> Column:
    return F.try_divide(F.aggregate(col(x), F.lit(0.0), lambda s, v: s + v), F.size(col(x)))


def array_std(x: str | Column) -> Column:
    """Population standard deviation of an array."""
    m = array_mean(x)
    return F.sqrt(F.try_divide(F.aggregate(col(x), F.lit(0.0), lambda s, v: s + (v - m) * (v - m)), F.size(col(x))))


def duration_seconds(text: str | Column) -> Column:
    """Leading number of texts such as "123 seconds"."""
    return F.expr(f"try_cast(regexp_extract({text}, '([0-9]+)', 1) as bigint)") if isinstance(text, str) else F.regexp_extract(text, "([0-9]+)", 1).try_cast("long")


def split_last(name: str | Column) -> tuple[Column, Column]:
    """The parts before and after the last underscore."""
    return F.regexp_extract(col(name), "^(.*)_([^_]+)$", 1), F.regexp_extract(col(name), "^(.*)_([^_]+)$", 2)


def renamed(value: str | Column, names: dict[str, str]) -> Column:
    """A value's name in a map; values without one stay."""
    pairs = [F.lit(x) for pair in names.items() for x in pair]
    return F.coalesce(F.element_at(F.create_map(*pairs), col(value)), col(value)) if pairs else col(value)

"""Running values along ordered series whose keys may hold any share of all rows.

A key's rows are cut into buckets that follow the order (days of a time, blocks of a turn number). Each
bucket gives one row that sums it up, these rows are combined along the key, and what lies before (or
after) a bucket enters it as one more row at its edge. So a key is spread over as many tasks as it has
buckets, and no task holds more than one bucket's rows and one row for each bucket of a key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import DAY, col
from tidemark.sources.scratch import stored


#: Microseconds of time that one bucket covers where nothing else is asked for.
BUCKET_US = DAY
#: Rows that one task sorts, about. Ordered series compress so well that tasks of a given number of shuffled bytes hold millions.
TASK_ROWS = 1 << 17


def spread(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """df dealt by columns to as many tasks as its number of rows asks for; few rows stay as they are."""
    return df.repartition(-(-rows // TASK_ROWS), *by) if rows > TASK_ROWS else df


def time_bucket(time: str | Column, width: int = BUCKET_US) -> Column:
    return F.floor(col(time) / width)


@dataclass(frozen=True)
class Running:
    """An aggregate of the rows before or after a row, with or without the row itself."""

    kind: str
    value: Column
    ahead: bool = False
    own: bool = False

    def over(self, value: Column, window) -> Column:
        return _WINDOW[self.kind](value).over(window)

    def whole(self, value: Column, order: list[str]) -> Column:
        if self.kind != "near":
            return _WINDOW[self.kind](value)
        at = F.when(value.isNotNull(), F.struct(*order))
        return (F.min_by if self.ahead else F.max_by)(value, at)


#: near: the nearest value that isn't null.
_WINDOW = {"sum": F.sum, "max": F.max, "min": F.min, "xor": F.bit_xor, "near": lambda v: F.last(v, ignorenulls=True)}


def total(value: str | Column | int = 1, own: bool = True, ahead: bool = False) -> Running:
    """Sum up to the row; null where nothing is summed."""
    return Running("sum", F.lit(value) if isinstance(value, int) else col(value), ahead, own)


def highest(value: str | Column, own: bool = True) -> Running:
    return Running("max", col(value), False, own)


def lowest(value: str | Column, own: bool = True) -> Running:
    return Running("min", col(value), False, own)


def mixed(value: str | Column, own: bool = True) -> Running:
    """Bitwise exclusive or up to the row."""
    return Running("xor", col(value), False, own)


def last(value: str | Column, own: bool = True) -> Running:
    """The nearest value at or before the row that isn't null."""
    return Running("near", col(value), False, own)


def first(value: str | Column, own: bool = True) -> Running:
    """The nearest value at or after the row that isn't null."""
    return Running("near", col(value), True, own)


def previous(*values: str) -> Running:
    """A struct of the row before; null at the key's first row, whatever that row holds."""
    return Running("near", F.struct(*values), False, False)


def following(*values: str) -> Running:
    """A struct of the row after; null at the key's last row."""
    return Running("near", F.struct(*values), True, False)


def scan(df: DataFrame, keys: list[str], order: list[str], bucket: Column, columns: dict[str, Running]) -> DataFrame:
    """df with the running values of each row among the rows of its key, in ascending order (nulls first).

    bucket must not fall along the order. Rows that are equal in keys and order are taken in any order.
    """
    df = stored(df.withColumn("_bucket", bucket), "series")  # read twice, and counted
    rows = df.count()
    data = df.withColumns({"_edge": F.lit(0)} | {f"_v_{n}": c.value for n, c in columns.items()})
    parts = spread(data, rows, *keys, "_bucket").groupBy(*keys, "_bucket").agg(*[c.whole(F.col(f"_v_{n}"), order).alias(f"_v_{n}") for n, c in columns.items()])
    parts = spread(parts, rows, *keys)
    along = Window.partitionBy(*keys)
    out = data
    for ahead in sorted({c.ahead for c in columns.values()}):
        mine = [(n, c) for n, c in columns.items() if c.ahead == ahead]
        before = along.orderBy(F.col("_bucket").desc() if ahead else F.col("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
        edge = parts.select(*keys, "_bucket", F.lit(1 if ahead else -1).alias("_edge"), *[c.over(F.col(f"_v_{n}"), before).alias(f"_v_{n}") for n, c in mine])
        edge = edge.where(" or ".join(f"_v_{n} is not null" for n, _ in mine))
        out = out.unionByName(edge, allowMissingColumns=True)
    inside = Window.partitionBy(*keys, "_bucket")
    up = inside.orderBy("_edge", *order)
    down = inside.orderBy(F.col("_edge").desc(), *[F.col(o).desc() for o in order])
    found = {n: c.over(F.col(f"_v_{n}"), (down if c.ahead else up).rowsBetween(Window.unboundedPreceding, 0 if c.own else -1)) for n, c in columns.items()}
    return spread(out, rows, *keys, "_bucket").withColumns(found).where("_edge = 0").drop("_bucket", "_edge", *[f"_v_{n}" for n in columns])


def with_halo(df: DataFrame, time: str, reach: int, width: int = BUCKET_US) -> DataFrame:
    """Rows in their bucket of time (_bucket), and again (_halo true) in the next one whose start they reach.

    A frame that looks back by less than `reach` finds all its rows within (key, _bucket).
    """
    width = max(width, reach)
    own, later = F.floor(F.col(time) / width), F.floor((F.col(time) + reach) / width)
    places = df.withColumn("_bucket", F.explode(F.when(later > own, F.array(own, later)).otherwise(F.array(own))))
    return places.withColumn("_halo", ~F.col("_bucket").eqNullSafe(own))

"""What came before a row in its owner's order, for owners of any size.

A state is associative: the last value, the largest, or a sum. Most owners are
one window partition. The order of an owner with more rows than a segment may
have is cut into ranges: states are summed up for each range, carried over the
ranges of the owner, and every range is finished by itself, so no task reads
more than a segment whatever one owner holds.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.shared import written

#: Rows of an owner's order that one task finishes, about.
SEGMENT_ROWS = 1_000_000
#: Owners that are cut into ranges, at most; the bar rises with the table so that there are never more.
LARGE_OWNERS = 1_000


@dataclass(frozen=True)
class State:
    """kind: last (of the values that are not null), max or sum."""

    kind: str
    value: Column

    def over(self, value: Column, window: Window) -> Column:
        return {"last": lambda c: F.last(c, ignorenulls=True), "max": F.max, "sum": F.sum}[self.kind](value).over(window)

    def of_range(self, value: Column, place: Column) -> Column:
        return F.max_by(value, F.when(value.isNotNull(), place)) if self.kind == "last" else {"max": F.max, "sum": F.sum}[self.kind](value)

    def joined(self, earlier: Column, later: Column) -> Column:
        if self.kind == "last":
            return F.coalesce(later, earlier)
        return F.greatest(later, earlier) if self.kind == "max" else F.when(later.isNull(), earlier).when(earlier.isNull(), later).otherwise(earlier + later)


def _of(df: DataFrame, other: DataFrame, columns: list[str], how: str) -> DataFrame:
    """df joined with few rows, which are broadcast; nulls in the columns are equal."""
    named = F.broadcast(other.withColumnsRenamed({c: f"_same_{c}" for c in columns}))
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"_same_{c}"))
    return df.join(named, same, how)


def _whole(df: DataFrame, owner: list[str], order: list[Column | str], states: dict[str, State]) -> DataFrame:
    before = Window.partitionBy(*owner).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.select("*", *[s.over(s.value, before).alias(n) for n, s in states.items()])


def large_owners(df: DataFrame, owner: list[str], rows: int) -> DataFrame | None:
    """Owners (with _rows) that have more rows than a segment may have, LARGE_OWNERS of them at most; None if there are none."""
    n = df.count()
    if n <= rows:
        return None
    large = written(df.groupBy(*owner).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > max(rows, n // LARGE_OWNERS)))
    return None if large.isEmpty() else large


def before_each(df: DataFrame, owner: list[str], order: list[Column | str], states: dict[str, State], rows: int | None = None) -> DataFrame:
    """df with, for each row, the states of the rows of its owner that come before it in a total order.

    Null owners are an owner. States are null for an owner's first row. The owners' sizes are counted
    first if the table has more rows than a segment.
    """
    rows = rows or SEGMENT_ROWS
    large = large_owners(df, owner, rows)
    if large is None:
        return _whole(df, owner, order, states)
    small = _whole(_of(df, large, owner, "left_anti"), owner, order, states)
    held = _of(df, large, owner, "left_semi").withColumns({f"_value_{n}": s.value for n, s in states.items()})
    parts = int(large.agg(F.sum("_rows")).first()[0] // rows) + 1
    by = [*[F.col(c) for c in owner], *order]
    # a row's place: its range and its number in it, written with the row
    ranged = written(held.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("_place", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("_range", F.shiftright("_place", 33))
    sums = ranged.groupBy(*owner, "_range").agg(*[s.of_range(F.col(f"_value_{n}"), F.col("_place")).alias(n) for n, s in states.items()])
    ranges = Window.partitionBy(*owner).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(*owner, "_range", *[s.over(F.col(n), ranges).alias(f"_carried_{n}") for n, s in states.items()])
    inside = Window.partitionBy(*owner, "_range").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.select("*", *[s.over(F.col(f"_value_{n}"), inside).alias(f"_local_{n}") for n, s in states.items()])
    # a row a large owner and range: parts and LARGE_OWNERS together at most
    met = _of(local, carried, [*owner, "_range"], "inner")
    done = met.select(*df.columns, *[s.joined(F.col(f"_carried_{n}"), F.col(f"_local_{n}")).alias(n) for n, s in states.items()])
    return small.unionByName(done)


def numbered(df: DataFrame, owner: list[str], order: list[Column | str], name: str = "rn", rows: int | None = None) -> DataFrame:
    """df with a row's number from 1 in its owner's order."""
    counted = before_each(df, owner, order, {name: State("sum", F.lit(1).cast("long"))}, rows)
    return counted.withColumn(name, (F.coalesce(F.col(name), F.lit(0)) + 1).cast("int"))

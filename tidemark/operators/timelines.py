"""Sequences: effective-dated intervals, as-of counts, state changes, monotonic series and event order.

What precedes a row comes from :mod:`tidemark.operators.scan`, which cuts the
order of a large owner into ranges; every order is total, so results do not
depend on partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.scan import State, before_each, numbered


def interval_faults(df: DataFrame, owner: str, start: str, end: str, identity: str, *, continuous: bool = False, skip_invalid: bool = False, running_end: bool = False) -> DataFrame:
    """Faulty intervals: owner, identity, code (no_start, reversed, overlap, after_open, gap).

    Only the interval just before counts, unless running_end asks for the latest end so far. An
    invalid interval still comes before the next one, unless skip_invalid leaves it out.
    """
    valid = F.col(start).isNotNull() & (F.col(end).isNull() | (F.col(end) >= F.col(start)))
    bad = F.when(F.col(start).isNull(), "no_start").when(~valid, "reversed")
    faults = df.select(owner, identity, bad.alias("code")).where("code IS NOT NULL")
    rows = (df.where(valid) if skip_invalid else df).select(owner, identity, F.col(start).alias("_start"), F.col(end).alias("_end"), valid.alias("_valid"))
    order, is_open = [F.col("_start").asc_nulls_first(), identity], F.col("_end").isNull()
    if running_end:
        rows = before_each(rows, [owner], order, {"_before": State("max", F.col("_end")), "_was_open": State("max", is_open)})
        before, was_open = F.col("_before"), F.col("_was_open")
    else:
        rows = before_each(rows, [owner], order, {"_last": State("last", F.struct(F.col("_end").alias("end"), is_open.alias("open")))})
        before, was_open = F.col("_last.end"), F.col("_last.open")
    code = F.when(was_open, "after_open").when(F.col("_start") <= before, "overlap")
    if continuous:
        code = code.when(F.datediff(F.col("_start"), before) > 1, "gap")
    at = rows.select(owner, identity, F.when(F.col("_valid"), code).alias("code"))
    return faults.unionByName(at.where("code IS NOT NULL"))


def as_of_faults(df: DataFrame, owner: str, start: str, end: str, at: str | Column) -> DataFrame:
    """Owners that not exactly one interval covers on a date: owner, n."""
    day = F.to_date(F.lit(at)) if isinstance(at, str) else at
    covers = (F.col(start) <= day) & (F.col(end).isNull() | (F.col(end) >= day))
    return df.groupBy(owner).agg(F.count_if(F.coalesce(covers, F.lit(False))).alias("n")).where("n <> 1")


def state_changes(df: DataFrame, owner: str, order: list[str], active: Column, date: str) -> DataFrame:
    """Events derived from states: owner, date, code (joined, ended, resumed) where the active flag turns."""
    rows = df.select(owner, *[c for c in dict.fromkeys([*order, date]) if c != owner], active.alias("_active"))
    rows = before_each(rows, [owner], order, {"_was": State("last", F.struct(F.col("_active").alias("active"))), "_ever": State("max", F.col("_active"))})
    now, was, ever = F.col("_active"), F.col("_was.active"), F.col("_ever")
    code = F.when(now & ~F.coalesce(ever, F.lit(False)), "joined").when(now & ~was, "resumed").when(~now & F.coalesce(was, F.lit(False)), "ended")
    return rows.select(owner, F.col(date).alias("date"), code.alias("code")).where("code IS NOT NULL")


def positional(expected: DataFrame, actual: DataFrame, owner: str, order: list[str], date: str, code: str) -> DataFrame:
    """The n-th expected event of an owner against the n-th actual one: owner, rn, fault (missing, extra, date, code)."""
    side = lambda df, s: numbered(df.select(owner, *[c for c in dict.fromkeys([*order, date, code]) if c != owner]), [owner], order).select(owner, "rn", F.col(date).alias(f"{s}_date"), F.col(code).alias(f"{s}_code"))
    both = side(expected, "e").withColumn("_e", F.lit(1)).join(side(actual, "a").withColumn("_a", F.lit(1)), [owner, "rn"], "full_outer")
    fault = F.when(F.col("_a").isNull(), "missing").when(F.col("_e").isNull(), "extra").when(~F.col("e_date").eqNullSafe(F.col("a_date")), "date").when(~F.col("e_code").eqNullSafe(F.col("a_code")), "code")
    return both.select(owner, "rn", fault.alias("fault")).where("fault IS NOT NULL")


def monotonic_faults(df: DataFrame, owner: str, sequence: str, at: str, identity: str, usage: str | None = None, unit: str | None = None, kind: Column | None = None) -> DataFrame:
    """Readings that break a series: owner, identity, code (sequence, time, kind, negative, no_unit). Each is held against the last valid reading before it."""
    valid = F.col(sequence).isNotNull() & F.col(at).isNotNull()
    held = {"sequence": F.col(sequence), "at": F.col(at)} | ({"kind": kind} if kind is not None else {})
    df = before_each(df, [owner], [F.col(sequence).asc_nulls_first(), identity], {f"_last_{n}": State("last", F.when(valid, c)) for n, c in held.items()})
    checks = [
        F.when(~valid | (F.col(sequence) <= F.col("_last_sequence")), F.lit("sequence")),
        F.when(F.col(at) <= F.col("_last_at"), F.lit("time")),
        *([F.when(kind != F.col("_last_kind"), F.lit("kind"))] if kind is not None else []),
        *([F.when(F.coalesce(F.col(usage) < 0, F.lit(True)), F.lit("negative"))] if usage else []),
        *([F.when(F.coalesce(F.col(unit) == "", F.lit(True)), F.lit("no_unit"))] if unit else []),
    ]
    return df.select(owner, identity, F.array_compact(F.array(*checks)).alias("codes")).select(owner, identity, F.explode("codes").alias("code"))


def order_faults(df: DataFrame, identity: list[str], earlier: str, later: str) -> DataFrame:
    """Rows whose earlier event is not before or with the later one, or where one is unknown."""
    return df.where(~F.coalesce(F.col(earlier) <= F.col(later), F.lit(False))).select(*identity, earlier, later)

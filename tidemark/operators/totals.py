"""Totals: exact sums with invalid counts, and grouped totals of both sides. Plain aggregates, so Spark combines map-side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import as_decimal


def exact_total(df: DataFrame, measure: str, key: str, scale: int = 2) -> DataFrame:
    """One row: total (null on overflow), n_rows, n_invalid (null or no number), overflowed, first_invalid (the smallest key of an invalid row)."""
    value = as_decimal(F.col(measure), scale)
    out = df.select(F.col(key).alias("_k"), value.alias("_v")).agg(
        F.try_sum("_v").alias("total"), F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("_v").isNull()).alias("n_invalid"),
        F.min(F.when(F.col("_v").isNull(), F.col("_k"))).alias("first_invalid"), F.count("_v").alias("_n"),
    )
    return out.withColumn("overflowed", F.col("total").isNull() & (F.col("_n") > 0)).withColumn("total", F.when(F.col("_n") == 0, F.lit(0)).otherwise(F.col("total")).cast(f"decimal(38,{scale})")).drop("_n")


def compare_exact(expected: DataFrame, actual: DataFrame, measure: str, key: str, scale: int = 2) -> DataFrame:
    """One row: both totals, their invalid counts, and whether they are equal (never with invalid values or an overflow)."""
    e, a = exact_total(expected, measure, key, scale), exact_total(actual, measure, key, scale)
    side = lambda df, s: df.select(*[F.col(c).alias(f"{s}_{c}") for c in df.columns], F.lit(1).alias("_j"))
    both = side(e, "expected").join(F.broadcast(side(a, "actual")), "_j").drop("_j")  # one row each
    return both.withColumn("equal", F.coalesce(F.expr("expected_n_invalid + actual_n_invalid = 0 AND NOT expected_overflowed AND NOT actual_overflowed AND expected_total = actual_total"), F.lit(False)))


def grouped_totals(expected: DataFrame, actual: DataFrame, group: list[str], measure: str, *, scale: int = 2, tolerance=0, compare_count: bool = True, on_invalid: str = "zero") -> DataFrame:
    """Groups whose count or total differs: group, expected and actual n and total, code (missing, unexpected, count, total).

    on_invalid: what a null or unparsable measure is: "zero"; "fail", its group gets the code invalid; "raise".
    """
    if on_invalid not in ("zero", "fail", "raise"):
        raise ValueError(f"on_invalid must be zero, fail or raise, not {on_invalid!r}")
    value = F.col(measure).cast(f"decimal(38,{scale})") if on_invalid == "raise" else as_decimal(F.col(measure), scale)
    if on_invalid == "raise":
        value = F.coalesce(value, F.raise_error(F.lit(f"{measure} is null")).cast(f"decimal(38,{scale})"))

    def side(df: DataFrame, s: str) -> DataFrame:
        return df.groupBy(*group).agg(F.count(F.lit(1)).alias(f"{s}_n"), F.sum(F.coalesce(value, F.lit(0))).cast(f"decimal(38,{scale})").alias(f"{s}_total"), F.count_if(value.isNull()).alias(f"{s}_invalid"))

    e, a = side(expected, "expected").alias("e"), side(actual, "actual").alias("a")
    on = F.lit(True)
    for g in group:
        on = on & F.col(f"e.{g}").eqNullSafe(F.col(f"a.{g}"))
    rest = [c for c in (*e.columns, *a.columns) if c not in group]
    both = e.join(a, on, "full_outer").select(*[F.coalesce(F.col(f"e.{g}"), F.col(f"a.{g}")).alias(g) for g in group], *rest)
    bad = F.coalesce("expected_invalid", F.lit(0)) + F.coalesce("actual_invalid", F.lit(0)) > 0
    code = F.when(F.lit(on_invalid == "fail") & bad, "invalid").when(F.col("actual_n").isNull(), "missing").when(F.col("expected_n").isNull(), "unexpected")
    if compare_count:
        code = code.when(F.col("expected_n") != F.col("actual_n"), "count")
    code = code.when(F.abs(F.col("expected_total") - F.col("actual_total")) > F.lit(tolerance), "total")
    return both.withColumn("code", code).where("code IS NOT NULL").drop("expected_invalid", "actual_invalid")

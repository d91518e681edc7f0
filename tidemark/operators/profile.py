"""Profiles of datasets and the drift between two of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def profile(df: DataFrame, dataset: str) -> DataFrame:
    """A row a field: type, nullable, ordinal, n_rows, n_null, n_empty. One pass over the data for all fields."""
    counts = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        empty = F.count_if(c == "") if f.dataType.simpleString() == "string" else F.lit(0).cast("long")
        counts.append(F.struct(F.count_if(c.isNull()).alias("n_null"), empty.alias("n_empty")))
    one = df.agg(F.count(F.lit(1)).alias("n_rows"), F.array(*counts).alias("counts"))
    fields = F.array(*[F.struct(F.lit(f.name).alias("field"), F.lit(f.dataType.simpleString()).alias("type"), F.lit(f.nullable).alias("nullable")) for f in df.schema.fields])
    each = one.select("n_rows", F.posexplode(F.arrays_zip(fields.alias("f"), F.col("counts").alias("c"))).alias("ordinal", "x"))
    return each.select(F.lit(dataset).alias("dataset"), "x.f.field", "x.f.type", "x.f.nullable", "ordinal", "n_rows", "x.c.n_null", "x.c.n_empty")


def inferred_types(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row a text column: the narrowest of integer, decimal, date, boolean that all its values parse as, mixed if some do, else string."""
    tries = {"integer": "bigint", "decimal": "decimal(38,6)", "date": "date", "boolean": "boolean"}
    out = df.agg(F.array(*[F.struct(F.lit(c).alias("field"), F.count(F.nullif(F.col(c), F.lit(""))).alias("n"), *[F.count(F.nullif(F.col(c), F.lit("")).try_cast(t)).alias(k) for k, t in tries.items()]) for c in columns]).alias("a"))
    kind = F.when(F.col("n") == 0, "empty")
    for k in tries:
        kind = kind.when(F.col(k) == F.col("n"), k)
    some = F.greatest(*[F.col(k) for k in tries]) > 0
    return out.select(F.explode("a").alias("x")).select("x.*").select("field", kind.when(some, "mixed").otherwise("string").alias("inferred"), "n")


def drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """Fields that were added, removed, retyped or changed in nullability between two profiles: dataset, field, change, was, now."""
    side = lambda df, s: df.select("dataset", "field", F.col("type").alias(f"{s}_type"), F.col("nullable").alias(f"{s}_null"))
    both = side(before, "b").join(side(after, "a"), ["dataset", "field"], "full_outer")
    changes = F.array_compact(F.array(
        F.when(F.col("b_type").isNull(), F.struct(F.lit("added").alias("change"), F.lit(None).cast("string").alias("was"), F.col("a_type").alias("now"))),
        F.when(F.col("a_type").isNull(), F.struct(F.lit("removed").alias("change"), F.col("b_type").alias("was"), F.lit(None).cast("string").alias("now"))),
        F.when(F.col("b_type") != F.col("a_type"), F.struct(F.lit("retyped").alias("change"), F.col("b_type").alias("was"), F.col("a_type").alias("now"))),
        F.when(F.col("b_null") != F.col("a_null"), F.struct(F.lit("nullability").alias("change"), F.col("b_null").cast("string").alias("was"), F.col("a_null").cast("string").alias("now"))),
    ))
    return both.select("dataset", "field", F.explode(changes).alias("x")).select("dataset", "field", "x.*")

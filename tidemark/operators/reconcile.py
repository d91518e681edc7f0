"""Expected against actual: presence, values, repeats, pairs and references.

Keys are joined as columns, so Catalyst picks the strategy; a side is only
aggregated or widened where the semantics ask for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import reference_key
from tidemark.operators.scan import numbered


def null_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows without a whole identity."""
    return df.where(" OR ".join(f"`{k}` IS NULL" for k in keys))


def missing(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Expected identities that were not observed."""
    return expected.join(actual.select(*keys), keys, "left_anti")


def unexpected(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Observed identities that nothing explains."""
    return actual.join(expected.select(*keys), keys, "left_anti")


def observed_counts(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Each expected row with n_observed, the number of actual rows of its identity."""
    counts = actual.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_observed"))
    return expected.join(counts, keys, "left").withColumn("n_observed", F.coalesce("n_observed", F.lit(0)))


def repeated(df: DataFrame, keys: list[str], least: str | None = None) -> DataFrame:
    """Identities that occur more than once, with n and, if asked, the smallest of a column."""
    more = [F.min(least).alias(f"least_{least}")] if least else []
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *more).where("n > 1")


def repeats_after_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Every row of an identity but its first, with its number (rn) in a total order."""
    return numbered(df, keys, order).where("rn > 1")


def once(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose identity occurs once; found by a count, so a much repeated identity is not gathered."""
    single = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n = 1").select(*keys)
    return df.join(single, keys, "left_semi")


def mismatches(expected: DataFrame, actual: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """One row a differing field: keys, field, expected, actual (as text). Identities that the target repeats are left to `repeated`.

    Only differing fields are exploded. A mapped field that the target lacks, or has with another type, is an error.
    """
    for f in fields:
        if f not in actual.columns or expected.schema[f].dataType != actual.schema[f].dataType:
            raise TypeError(f"field {f!r} differs in kind between the sides")
    e = expected.select(*keys, F.struct(*fields).alias("_e"))
    a = once(actual, keys).select(*keys, F.struct(*fields).alias("_a"))
    differ = [F.when(~F.col(f"_e.{f}").eqNullSafe(F.col(f"_a.{f}")), F.struct(F.lit(f).alias("field"), F.col(f"_e.{f}").cast("string").alias("expected"), F.col(f"_a.{f}").cast("string").alias("actual"))) for f in fields]
    return e.join(a, keys).select(*keys, F.explode(F.array_compact(F.array(*differ))).alias("d")).select(*keys, "d.*")


def compared(expected: DataFrame, actual: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """One row: n_compared and n_matching identities."""
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f"_e.{f}").eqNullSafe(F.col(f"_a.{f}"))
    both = expected.select(*keys, F.struct(*fields).alias("_e")).join(once(actual, keys).select(*keys, F.struct(*fields).alias("_a")), keys)
    return both.agg(F.count(F.lit(1)).alias("n_compared"), F.count_if(same).alias("n_matching"))


def paired(expected: DataFrame, actual: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The n-th expected row of an identity beside the n-th actual one: keys, rn, e and a (structs). order must be total for a stable result."""
    side = lambda df, name: numbered(df, keys, order).select(*keys, "rn", F.struct(*[c for c in df.columns if c not in keys]).alias(name))
    return side(expected, "e").join(side(actual, "a"), [*keys, "rn"])


def keyed(expected: DataFrame, actual: DataFrame, keys: list[str], fields: list[str], amount: str | None = None, tolerance=0, always_fields: bool = False) -> DataFrame:
    """Faults of each expected identity: missing, repeated, amount, fields. keys and code.

    Groups are aggregated first and met in a full outer join; identities of the target alone are left
    to `unexpected`. Any second row of the target is a repeat, whatever was expected. The least row of
    a group (by amount and fields) stands for it. With always_fields the
    fields are compared even where the amount differs.
    """
    used = [*([amount] if amount else []), *fields]
    group = lambda df, n, s: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(n), F.min(F.struct(*used)).alias(s))
    both = group(expected, "n_e", "e").join(group(actual, "n_a", "a"), keys, "full_outer").where("n_e IS NOT NULL")
    off = F.coalesce(F.abs(F.col(f"e.{amount}") - F.col(f"a.{amount}")) > F.lit(tolerance), F.lit(True)) if amount else F.lit(False)
    differ = F.lit(False)
    for f in fields:
        differ = differ | (F.coalesce(F.col(f"e.{f}").cast("string"), F.lit("")) != F.coalesce(F.col(f"a.{f}").cast("string"), F.lit("")))
    there = F.col("n_a").isNotNull()
    codes = F.array_compact(F.array(
        F.when(~there, F.lit("missing")), F.when(F.col("n_a") > 1, F.lit("repeated")),
        F.when(there & off, F.lit("amount")), F.when(there & differ & (F.lit(always_fields) | ~off), F.lit("fields")),
    ))
    return both.select(*keys, F.explode(codes).alias("code"))


def exactly_one(expected: DataFrame, actual: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Expected identities that are not there exactly once with equal fields: keys, code (missing, repeated, fields)."""
    group = actual.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_a"), F.min(F.struct(*fields)).alias("a"))
    differ = F.lit(False)
    for f in fields:
        differ = differ | ~F.col(f).eqNullSafe(F.col(f"a.{f}"))
    code = F.when(F.col("n_a").isNull(), "missing").when(F.col("n_a") > 1, "repeated").when(differ, "fields")
    return expected.join(group, keys, "left").select(*keys, code.alias("code")).where("code IS NOT NULL")


def unresolved(df: DataFrame, reference: str | Column, referenced: DataFrame, key: str) -> DataFrame:
    """Rows whose reference does not exist; null and empty references never do."""
    ref = F.col(reference) if isinstance(reference, str) else reference
    named = df.withColumn("_ref", F.when(ref.cast("string") != "", ref))
    return named.join(referenced.select(F.col(key).alias("_ref")).where("_ref IS NOT NULL").distinct(), "_ref", "left_anti").drop("_ref")


def unresolved_typed(df: DataFrame, reference: str, kind: str, referenced: DataFrame, key: str) -> DataFrame:
    """Rows whose reference `kind/id` has another kind or shape, or names no row."""
    return unresolved(df, reference_key(F.col(reference), kind), referenced.select(F.col(key).cast("string").alias(key)), key)


def owners(expected: DataFrame, actual: DataFrame, keys: list[str], owner: str, known_owners: DataFrame, owner_key: str, fields: list[str] = (), amount: str | None = None, tolerance=0) -> DataFrame:
    """Faults of owned rows: missing, repeated, owner (another one), orphan (no such owner), fields, amount. keys and code."""
    e = expected.select(*keys, F.struct(owner, *fields, *([amount] if amount else [])).alias("e"))
    a = actual.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(owner, *fields, *([amount] if amount else []))).alias("a"))
    known = known_owners.select(F.col(owner_key).alias("_owner")).distinct().withColumn("_known", F.lit(True))
    both = e.join(a, keys, "left").withColumn("_owner", F.col(f"a.{owner}")).join(known, "_owner", "left")
    differ = F.lit(False)
    for f in fields:
        differ = differ | ~F.col(f"e.{f}").eqNullSafe(F.col(f"a.{f}"))
    there = F.col("n").isNotNull()
    off = F.coalesce(F.abs(F.col(f"e.{amount}") - F.col(f"a.{amount}")) > F.lit(tolerance), F.lit(True)) if amount else F.lit(False)
    codes = F.array_compact(F.array(
        F.when(~there, F.lit("missing")), F.when(F.col("n") > 1, F.lit("repeated")), F.when(there & ~F.col(f"e.{owner}").eqNullSafe(F.col(f"a.{owner}")), F.lit("owner")),
        F.when(there & F.col("_known").isNull(), F.lit("orphan")), F.when(there & differ, F.lit("fields")), F.when(there & off, F.lit("amount")),
    ))
    return both.select(*keys, F.explode(codes).alias("code"))


def set_equal(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """One row: n_left_only, n_right_only, equal, over distinct keys."""
    side = lambda df, n: df.select(*keys).distinct().withColumn(n, F.lit(1))
    both = side(left, "_l").join(side(right, "_r"), keys, "full_outer")
    counts = both.agg(F.count_if(F.col("_r").isNull()).alias("n_left_only"), F.count_if(F.col("_l").isNull()).alias("n_right_only"))
    return counts.withColumn("equal", F.expr("n_left_only = 0 AND n_right_only = 0"))


def bag_difference(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Multiset comparison: keys, n_before, n_after, persisting, resolved, added."""
    count = lambda df, n: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(n))
    both = count(before, "n_before").join(count(after, "n_after"), keys, "full_outer").na.fill(0, ["n_before", "n_after"])
    return both.select(*keys, "n_before", "n_after", F.least("n_before", "n_after").alias("persisting"), F.greatest(F.col("n_before") - F.col("n_after"), F.lit(0)).alias("resolved"), F.greatest(F.col("n_after") - F.col("n_before"), F.lit(0)).alias("added"))

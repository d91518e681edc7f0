"""Fingerprints over the order of keys, and the key ranges in which two captures differ.

Keys are written as digits that sort as the keys do. The rows that share all
but the last digits are a range; ranges with the same digits before are a wider
one, up to the whole table. A range's digest is made of the digests of the
ranges in it, in order, so equal digests mean equal rows in equal order, and a
difference is found by going down only where digests differ. What a range is
depends on the keys alone, so captures of any partitioning have the same ranges.

A bottom range sums its rows' digests instead of listing them: every row holds
its key, so the set of rows has one order only. Sums are combined before they
are sent; no range is gathered however many rows it has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.canonical import LANES, row_fingerprint
from tidemark.shared import written

#: Hexadecimal digits of a key; of the last key, those that a bottom range's keys may differ in; those that a level takes.
WIDTH, LOW, STEP = 16, 3, 2


def sortable(c: Column, kind: T.DataType) -> Column:
    """16 digits that sort as the values do (text: its first 8 bytes); null sorts first."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        number = c.cast("long")
    elif isinstance(kind, T.DateType):
        number = F.unix_date(c).cast("long")
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        number = F.unix_micros(c.cast("timestamp"))
    elif isinstance(kind, T.DecimalType) and kind.precision <= 18:
        number = (c * F.lit(10**kind.scale)).cast("long")
    elif isinstance(kind, T.StringType):
        return F.rpad(F.coalesce(F.lower(F.hex(F.substring(c.cast("binary"), 1, 8))), F.lit("")), WIDTH, "0")
    else:
        raise TypeError(f"{kind.simpleString()} is no key type")
    # the sign bit is turned, so that negative numbers come first
    digits = F.lower(F.hex(number.bitwiseXOR(F.lit(-(1 << 63)))))
    return F.coalesce(F.lpad(digits, WIDTH, "0"), F.lit("0" * WIDTH))


def bottom_ranges(df: DataFrame, keys: list[str], columns: list[str] | None = None, low: int = LOW) -> DataFrame:
    """A row a bottom range: range (its digits), n, digest. columns: what of the rows counts (all by default, the keys in any case)."""
    columns = sorted({*(columns or df.columns), *keys})
    digits = F.concat(*[sortable(F.col(k), df.schema[k].dataType) for k in keys])
    hashed = df.select(F.substring(digits, 1, WIDTH * len(keys) - low).alias("range"), row_fingerprint(df, columns).alias("h"))
    lanes = [F.sum(F.conv(F.substring("h", 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)")).cast("decimal(38,0)").alias(f"lane{i}") for i in range(LANES)]
    sums = hashed.groupBy("range").agg(F.count(F.lit(1)).alias("n"), *lanes)
    return sums.select("range", "n", F.sha2(F.concat_ws(":", "range", "n", *[f"lane{i}" for i in range(LANES)]), 256).alias("digest"))


def wider(ranges: DataFrame, digits: int) -> DataFrame:
    """The ranges of the first digits: range, n, digest."""
    inside = F.array_sort(F.collect_list(F.struct("range", "digest")))
    return ranges.groupBy(F.substring("range", 1, digits).alias("wide")).agg(F.sum("n").alias("n"), inside.alias("inside")).select(F.col("wide").alias("range"), "n", F.sha2(F.concat_ws(":", "wide", F.array_join(F.col("inside.digest"), ":")), 256).alias("digest"))


def levels(ranges: DataFrame, length: int, step: int = STEP) -> list[DataFrame]:
    """Ranges of every width, from the bottom to the whole table (of no digits). A range holds 16 ** step narrower ones at most."""
    out = [ranges]
    while length > 0:
        length = max(0, length - step)
        out.append(wider(out[-1], length))
    return out


def ordered_fingerprint(df: DataFrame, keys: list[str], columns: list[str] | None = None) -> str:
    """The digest of the whole table in the order of its keys; of an empty one, the empty text. Only this one row comes to the driver."""
    top = levels(bottom_ranges(df, keys, columns), WIDTH * len(keys) - LOW)[-1].first()
    return top["digest"] if top else ""


def divergent_ranges(before: DataFrame, after: DataFrame, keys: list[str], columns: list[str] | None = None, low: int = LOW) -> DataFrame:
    """The bottom ranges that differ between two captures: range, n_before, n_after (0 where a capture has none).

    Goes down from the top and looks only into ranges that differ, so two captures that are alike but for
    a few rows are told apart by few digests once their bottom ranges are summed up.
    """
    columns = columns or [c for c in before.columns if c in after.columns]
    length = WIDTH * len(keys) - low
    sides = [levels(written(bottom_ranges(df, keys, columns, low)), length) for df in (before, after)]
    widths = [length]
    while widths[-1] > 0:
        widths.append(max(0, widths[-1] - STEP))
    differ = None
    for i in reversed(range(len(widths))):
        b, a = sides[0][i], sides[1][i]
        if differ is not None:
            wide = differ.select(F.col("range").alias("_wide"))
            b, a = (x.join(wide, F.substring("range", 1, widths[i + 1]) == F.col("_wide"), "left_semi") for x in (b, a))
        met = b.select("range", F.col("n").alias("n_before"), F.col("digest").alias("_b")).join(a.select("range", F.col("n").alias("n_after"), F.col("digest").alias("_a")), "range", "full_outer")
        differ = written(met.where(~F.col("_b").eqNullSafe(F.col("_a"))).select("range", F.coalesce("n_before", F.lit(0)).alias("n_before"), F.coalesce("n_after", F.lit(0)).alias("n_after")))
        if differ.isEmpty():
            break
    return differ

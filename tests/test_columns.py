"""Column builders on hand-made values."""

import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.functions.canonical import row_fingerprint, set_fingerprint


def one(spark, column, *values):
    """The column over rows of a single text field x."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r.y for r in df.select("i", column.alias("y")).orderBy("i").collect()]




def test_strip_and_upper(spark):
    X = F.col("x")  # noqa: N806
    assert one(spark, C.strip(X), " \t a b \n", None, "") == ["a b", None, ""]
    assert one(spark, C.normalize_upper("x"), "ﬁ straße", None) == ["FI STRAßE", None]


def test_dates(spark):
    X = F.col("x")  # noqa: N806
    day = datetime.date(2024, 2, 29)
    assert one(spark, C.as_date(X), "2024-02-29", "20240229", "2023-02-29", "x", None) == [day, day, None, None, None]
    assert one(spark, C.parse_date(X, "dd.MM.yyyy"), "29.02.2024", "2024") == [day, None]


def test_numbers(spark):
    X = F.col("x")  # noqa: N806
    assert one(spark, C.exact_decimal(X, 2), "1.50", "1.500", "1.505", "abc", "-7", None) == [Decimal("1.50"), Decimal("1.50"), None, None, Decimal("-7.00"), None]
    assert one(spark, C.declared(X, "decimal", scale=2, implied=True), "12345", "-5", "1.2") == [Decimal("123.45"), Decimal("-0.05"), None]
    assert one(spark, C.declared(X, "boolean", true=("Y",), false=("N",)), "Y", "N", "?") == [True, False, None]
    assert one(spark, C.as_text(X.cast("decimal(10,4)"), "decimal(10,4)"), "1.5000", "2.0000", "100", None) == ["1.5", "2", "100", ""]


def test_codes_and_parts(spark):
    X = F.col("x")  # noqa: N806
    assert one(spark, C.code_map(X, {"a": "1"}), "a", "A", None) == ["1", None, None]
    assert one(spark, C.code_map(X, {"a": "1"}, "keep"), "a", "b", None) == ["1", "b", None]
    assert one(spark, C.code_map(X, {"a": "1"}, "default", "?"), "b", None) == ["?", None]
    with pytest.raises(ValueError):
        C.code_map(X, {}, "other")
    assert one(spark, C.join_strict("-", X, F.lit("z")), "a", None) == ["a-z", None]
    assert one(spark, C.split_literal(X, "."), "a.b", "ab") == [["a", "b"], ["ab"]]


def test_times_and_references(spark):
    X = F.col("x")  # noqa: N806
    assert one(spark, C.has_offset(X), "2024-01-01T00:00:00Z", "2024-01-01T00:00:00+02:00", "2024-01-01T00:00:00", "xT Z", None) == [True, True, False, False, False]
    kinds = one(spark, C.timestamp_kind(X), "2024-01-01T02:00:00+02:00", "2024-01-01T00:00:00")
    assert kinds[0].micros == kinds[1].micros and kinds[0].has_offset and not kinds[1].has_offset
    assert one(spark, C.reference_key(X, "Patient"), "Patient/7", "Patient/7/8", "Group/7", "Patient/", None) == ["7", None, None, None, None]


def test_comparisons(spark):
    X = F.col("x")  # noqa: N806
    assert one(spark, C.beyond(X.cast("decimal(10,2)"), F.lit("1.00").cast("decimal(10,2)"), 0.01), "1.01", "1.02", None) == [False, True, True]
    assert one(spark, C.same_digest(X, F.lit("AB")), "ab", "", None) == [True, False, False]
    assert one(spark, C.redacted(X, ("ok",)), "ok")[0] == "ok" and one(spark, C.redacted(X, ("ok",)), "secret")[0].startswith("sha256:")
    assert one(spark, C.percentage(X.cast("int"), F.lit(0)), "1") == [None]


def test_glob():
    import re

    assert re.match(C.glob_regex("a/**/*.csv"), "a/b/c/x.csv") and re.match(C.glob_regex("a/**/*.csv"), "a/x.csv")
    assert not re.match(C.glob_regex("a/*.csv"), "a/b/x.csv") and re.match(C.glob_regex("?.txt"), "é.txt")


def test_fingerprints(spark):
    rows = [(i, f"n{i}", Decimal(i), [i, None], None) for i in range(50)]
    schema = "a long, b string, c decimal(10,2), d array<long>, e struct<x:int>"
    df = spark.createDataFrame(rows, schema)
    assert set_fingerprint(df.repartition(7), "t") == set_fingerprint(df.orderBy(F.desc("a")).coalesce(1), "t")
    assert set_fingerprint(df.withColumn("b", F.when(F.col("a") == 3, "x").otherwise(F.col("b"))), "t") != set_fingerprint(df, "t")
    assert set_fingerprint(df.union(df.limit(1)), "t") != set_fingerprint(df, "t")
    kinds = spark.range(1).select(F.lit(1).cast("long").alias("v")), spark.range(1).select(F.lit(1).cast("decimal(5,0)").alias("v"))
    assert len({k.select(row_fingerprint(k)).first()[0] for k in kinds}) == 2
    with pytest.raises(TypeError):
        row_fingerprint(spark.range(1).select(F.lit(1.0).alias("v")))

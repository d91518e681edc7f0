"""Canonical text and fingerprints of values, rows and sets of rows.

A value's text carries its kind, so integer 1 and decimal 1 differ. A set's
fingerprint is the sum of its rows' SHA-256 values modulo 2 to the 256, so it
does not depend on order or partitioning and is merged map-side: eight sums of
32-bit lanes, whose carries are joined on the driver.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.columns import as_text, prefixed

LANES = 8


def canonical(c: Column, kind: T.DataType) -> Column:
    """Text of a value with its kind; null is a kind of its own."""
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        body = F.concat(F.lit("object:"), *[prefixed(F.lit(f.name), canonical(c[f.name], f.dataType)) for f in fields])
    elif isinstance(kind, T.ArrayType):
        body = F.concat(F.lit("list:"), F.array_join(F.transform(c, lambda x: prefixed(canonical(x, kind.elementType))), ""))
    elif isinstance(kind, T.MapType):
        entries = F.array_sort(F.map_entries(c))
        body = F.concat(F.lit("object:"), F.array_join(F.transform(entries, lambda x: prefixed(x["key"].cast("string"), canonical(x["value"], kind.valueType))), ""))
    elif isinstance(kind, T.BinaryType):
        body = F.concat(F.lit("binary:"), F.sha2(c, 256))
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        raise TypeError("floating-point values have no exact text; cast them to decimal first")
    else:
        name = {"bigint": "integer", "int": "integer", "smallint": "integer", "tinyint": "integer"}.get(kind.simpleString(), kind.simpleString().partition("(")[0])
        body = F.concat(F.lit(f"{name}:"), as_text(c, kind.simpleString()))
    return F.when(c.isNull(), F.lit("null:")).otherwise(body)


def value_fingerprint(c: Column, kind: T.DataType) -> Column:
    return F.sha2(canonical(c, kind).cast("binary"), 256)


def row_fingerprint(df: DataFrame, columns: list[str] | None = None) -> Column:
    """A digest of the named fields (all by default), whatever their order."""
    parts = [prefixed(F.lit(n), canonical(F.col(f"`{n}`"), df.schema[n].dataType)) for n in sorted(columns or df.columns)]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def set_lanes(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row: n_rows and the sums of the eight lanes of the rows' digests (decimal, so that they cannot overflow)."""
    hashed = df.select(row_fingerprint(df, columns).alias("h"))
    lanes = [F.coalesce(F.sum(F.conv(F.substring("h", 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)")), F.lit(0)).cast("decimal(38,0)").alias(f"lane{i}") for i in range(LANES)]
    return hashed.agg(F.count(F.lit(1)).alias("n_rows"), *lanes)


def set_fingerprint(df: DataFrame, name: str = "", columns: list[str] | None = None) -> str:
    """The fingerprint of a set of rows, with its count and name; only the nine sums come to the driver."""
    row = set_lanes(df, columns).first()
    total = sum(int(row[f"lane{i}"]) << 32 * (LANES - 1 - i) for i in range(LANES)) % (1 << 256)
    return hashlib.sha256(f"{name}\x1f{row['n_rows']}\x1f{total:064x}".encode()).hexdigest()


def composed(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with the named texts in normal form C, so that composed and decomposed characters get one fingerprint.

    Spark has no function for it. Rows whose texts hold nothing beyond U+02FF are in that form already and
    stay in the JVM; only the others are sent to a Python worker.
    """
    done = F.lit(True)
    for c in columns:
        done = done & F.coalesce(F.col(c).rlike(r"^[\x{0}-\x{2FF}]*$"), F.lit(True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in columns:
                i = batch.schema.get_field_index(c)
                texts = [None if t is None else unicodedata.normalize("NFC", t) for t in batch.column(i).to_pylist()]
                batch = batch.set_column(i, batch.schema.field(i), pa.array(texts, batch.schema.field(i).type))
            yield batch

    return df.where(done).unionByName(df.where(~done).mapInArrow(run, df.schema))

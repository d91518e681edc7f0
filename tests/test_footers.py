"""What a Parquet file's footer must not hold, also where Spark would read it in silence."""

import datetime as dt

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tidemark.sources import readers


def table(**columns):
    return pa.table({"id": pa.array([1, 2], pa.int64())} | columns)


STAMP = [dt.datetime(2024, 1, 1), None]


def test_footers(spark, tmp_path):
    (tmp_path / "ok").mkdir()
    pq.write_table(table(name=pa.array(["a", None]), at=pa.array(STAMP, pa.timestamp("us", "UTC")), money=pa.array([1, 2], pa.decimal128(12, 2))), tmp_path / "ok/a.parquet")
    pq.write_table(table(name=pa.array(["a", None]), at=pa.array(STAMP, pa.timestamp("us", "UTC")), money=pa.array([1, 2], pa.decimal128(12, 2))), tmp_path / "ok/b.parquet")
    rows = {(r.column, r.physical, r.repetition) for r in readers.parquet_footers(spark, str(tmp_path / "ok"), files_a_task=1).collect()}
    assert {c for c, _, _ in rows} == {"id", "name", "at", "money"} and ("name", "BYTE_ARRAY", "optional") in rows and ("id", "INT64", "optional") in rows
    assert readers.read_parquet(spark, str(tmp_path / "ok")).count() == 4


@pytest.mark.parametrize("kind", ["int96", "int96_by_spark", "nanoseconds", "time"])
def test_refused(spark, tmp_path, kind):
    at = tmp_path / "t"
    at.mkdir()
    pq.write_table(table(x=pa.array(STAMP, pa.timestamp("us"))), at / "a.parquet")
    if kind == "int96":
        pq.write_table(table(x=pa.array(STAMP, pa.timestamp("us"))), at / "b.parquet", use_deprecated_int96_timestamps=True)
    elif kind == "int96_by_spark":
        was = spark.conf.get("spark.sql.parquet.outputTimestampType")
        spark.conf.set("spark.sql.parquet.outputTimestampType", "INT96")
        spark.sql("SELECT 1L AS id, TIMESTAMP '2024-01-01 00:00:00' AS x").write.mode("append").parquet(str(at))
        spark.conf.set("spark.sql.parquet.outputTimestampType", was)
    elif kind == "nanoseconds":
        pq.write_table(table(x=pa.array(STAMP, pa.timestamp("ns"))), at / "b.parquet", version="2.6")
    else:
        pq.write_table(table(x=pa.array([dt.time(1), None], pa.time64("us"))), at / "b.parquet")
    with pytest.raises(TypeError, match="x: "):
        readers.read_parquet(spark, str(at))

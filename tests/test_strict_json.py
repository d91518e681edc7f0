"""Strict JSON: repeated properties, inexact numbers and values of other kinds are rejects with their places."""

import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.sources import readers, strict_json
from tidemark.sources.strict_json import Property, exact_number

P = [
    Property("id", "integer"), Property("name"), Property("amount", "decimal", scale=25), Property("on", "boolean"), Property("day", "date"), Property("city", path="address.city"),
    Property("tags", "collection"), Property("more", "object"),
]

GOOD = [
    '{"id":1,"name":"a","amount":0.1234567890123456789012345,"on":true,"day":"2024-02-29","address":{"city":"x","zip":1},"tags":[1,"b"],"more":{"k":1}}',
    '{"id":"2","amount":"12.50","on":"false"}',
    '{"id":3,"amount":1500,"name":null,"address":{}}',
    '{"id":9007199254740993,"amount":-0.0,"name":"\\u00e9\\n"}',
]
BAD = {
    "broken": ("syntax", None), "": ("syntax", None), '{"id":1': ("syntax", None), "[1]": ("not_an_object", None), '"x"': ("not_an_object", None),
    '{"id":1,"id":2}': ("repeated", None), '{"id":1,"address":{"city":"a","city":"b"}}': ("repeated", None), '{"other":{"k":1,"k":1}}': ("repeated", None),
    '{"id":1.5}': ("kind", "id"), '{"id":true}': ("kind", "id"), '{"name":5}': ("kind", "name"), '{"amount":0.12345678901234567890123456}': ("kind", "amount"), '{"amount":1e-30}': ("kind", "amount"), '{"amount":1.5e3}': ("kind", "amount"),
    '{"on":1}': ("kind", "on"), '{"day":"2024-02-30"}': ("kind", "day"), '{"tags":{}}': ("kind", "tags"), '{"more":{"x":1e400}}': ("kind", "more"), '{"id":12345678901234567890}': ("kind", "id"),
}


def test_ndjson(spark, tmp_path):
    lines = [*GOOD[:2], *BAD, *GOOD[2:]]
    (tmp_path / "n.json").write_text("\n".join(lines) + "\n")
    rows, rejects = strict_json.read_ndjson(spark, str(tmp_path / "n.json"), P)
    got = {r.id: r for r in rows.collect()}
    assert set(got) == {1, 2, 3, 9007199254740993}
    one = got[1]
    assert (one.name, one.amount, one.on, str(one.day), one.city, json.loads(one.tags), json.loads(one.more)) == ("a", Decimal("0.1234567890123456789012345"), True, "2024-02-29", "x", [1, "b"], {"k": 1})
    assert (got[2].amount, got[2].on, got[2].name) == (Decimal("12.5"), False, None) and got[3].amount == 1500 and got[3].city is None
    assert got[9007199254740993].name == "é\n" and got[9007199254740993].amount == 0
    assert {(r.line, r.code, r.property) for r in rejects.collect()} == {(3 + i, *v) for i, v in enumerate(BAD.values())}


def test_line_numbers_of_split_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for f in range(2):
        (tmp_path / f"in/{f}.json").write_text("".join(('{"id":%d}' % i if i % 97 else "bad") + "\n" for i in range(1, 5000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        rows, rejects = strict_json.read_ndjson(spark, str(tmp_path / "in"), P[:1])
        assert rows.rdd.getNumPartitions() > 10
        assert sorted(r.line for r in rejects.collect()) == sorted([i for i in range(97, 5000, 97)] * 2)
        assert rows.count() == 2 * (4999 - 51)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_arrays(spark, tmp_path):
    records = [x for x in [*GOOD, *BAD] if x.startswith(("{", "[", '"')) and BAD.get(x, ("",))[0] not in ("syntax", "repeated")]
    (tmp_path / "a.json").write_text("[\n" + ",\n".join(records) + "]")
    (tmp_path / "b.json").write_text('[{"id":1,"id":2}]')
    (tmp_path / "c.json").write_text('{"id":1}')
    (tmp_path / "d.json").write_text("[1,")
    rows, rejects = strict_json.read_array(spark, str(tmp_path), P)
    assert {r.id for r in rows.collect()} == {1, 2, 3, 9007199254740993}
    got = {(r.file[-6:-5], r.position, r.code, r.property) for r in rejects.collect()}
    assert got == {("b", None, "repeated", None), ("c", None, "not_an_array", None), ("d", None, "syntax", None)} | {("a", i, *BAD[x]) for i, x in enumerate(records) if x in BAD}


def test_undeclared(spark, tmp_path):
    (tmp_path / "n.json").write_text('{"a":{"b":1},"c":0.1234567890123456789012345}\n{"a":1,"a":2}\n{"a":0.12345678901234567890123456789012345678901}\n')
    rows, rejects = strict_json.read_ndjson(spark, str(tmp_path / "n.json"))
    assert [r.x for r in rows.select(F.variant_get("record", "$.c", "decimal(38,25)").alias("x")).collect()] == [Decimal("0.1234567890123456789012345")]
    assert {(r.line, r.code) for r in rejects.collect()} == {(2, "repeated"), (3, "kind")}


def test_exact_number(spark):
    cases = {"1": "1", "-1.50": "-1.5", "1e2": None, "0.125": "0.125", "0.0001": None, "0.00000": "0", "10.1200": "10.12", "12345678901234567890123456789012345": "12345678901234567890123456789012345", "1" * 36: None, "01x": None}
    df = spark.createDataFrame([(c,) for c in cases], "c string")
    assert {r.c: r.d for r in df.select("c", exact_number(F.col("c"), 3).alias("d")).collect()} == {k: None if v is None else Decimal(v) for k, v in cases.items()}


def test_declared_schema_of_the_reader(spark, tmp_path):
    """The probes that were read in silence: refused, or kept digit by digit."""
    (tmp_path / "n.json").write_text('{"a":1,"a":2,"b":0.1234567890123456789012345}\n')
    with pytest.raises(Exception, match="repeated"):
        readers.read_json(spark, str(tmp_path / "n.json"), "a int, b decimal(38,25)", lines=True).collect()
    (tmp_path / "m.json").write_text('{"a":1,"b":0.1234567890123456789012345}\n')
    assert readers.read_json(spark, str(tmp_path / "m.json"), "a int, b decimal(38,25)", lines=True).first().b == Decimal("0.1234567890123456789012345")
    with pytest.raises(Exception, match="kind"):
        readers.read_json(spark, str(tmp_path / "m.json"), "a int, b decimal(38,5)", lines=True).collect()
    with pytest.raises(ValueError):
        Property("x", path="a[0]").at

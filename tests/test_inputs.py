"""Inputs of runs by bucket, composed texts, database catalogues, and an entry without the optional operators."""

import importlib
import unicodedata

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tidemark.functions.canonical import composed, set_fingerprint
from tidemark.operators import runs
from tidemark.sources import readers


def test_changed_inputs(spark):
    df = spark.range(500).select("id", (F.col("id") * 3).alias("v"))
    of = lambda x: runs.input_buckets(x, ["id"], digits=2)
    assert runs.changed_inputs({"d": of(df)}, {"d": of(df.repartition(7))}).isEmpty()
    after = df.where("id <> 7").withColumn("v", F.when(F.col("id") == 9, 0).otherwise(F.col("v")))
    bucket = {r.id: r.b for r in df.select("id", F.substring(F.sha2(F.concat(F.length(F.col("id").cast("string")), F.lit(":"), "id"), 256), 1, 2).alias("b")).collect()}
    got = {(r.dataset, r.bucket): (r.n_before - r.n_after, r.change) for r in runs.changed_inputs({"d": of(df), "gone": of(df.limit(1))}, {"d": of(after)}).collect()}
    assert got[("d", bucket[7])][0] == 1 and got[("d", bucket[9])] == (0, "changed") and len(got) == 3 and {v[1] for k, v in got.items() if k[0] == "gone"} == {"removed"}


def test_composed(spark):
    one = ["plain", "Zoë é", None, "ά", "한국", "ạ̇", ""]
    two = [x and unicodedata.normalize("NFD", x) for x in one]
    frame = lambda texts: spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    a, b = composed(frame(one), ["t"]), composed(frame(two), ["t"])
    want = {i: x and unicodedata.normalize("NFC", x) for i, x in enumerate(one)}
    assert {r.id: r.t for r in a.collect()} == {r.id: r.t for r in b.collect()} == want and set_fingerprint(a) == set_fingerprint(b) != set_fingerprint(frame(two))


def test_database_catalogues(spark):
    rows = [("s", "order", "pk", "PRIMARY KEY", "b", 2, None, None, None), ("s", "order", "pk", "PRIMARY KEY", "a", 1, None, None, None), ("s", "line", "fk", "FOREIGN KEY", "y", 2, "s", "order", "b"), ("s", "line", "fk", "FOREIGN KEY", "x", 1, "s", "order", "a")]
    names = "TABLE_SCHEMA string, TABLE_NAME string, CONSTRAINT_NAME string, KIND string, COLUMN_NAME string, ORDINAL_POSITION decimal(10,0), TO_SCHEMA string, TO_TABLE string, TO_COLUMN string"
    from decimal import Decimal

    keys = {r.constraint_name: r for r in readers.keys_of(spark.createDataFrame([(*r[:5], Decimal(r[5]), *r[6:]) for r in rows], names)).collect()}
    assert (keys["pk"].kind, keys["pk"]["columns"], keys["pk"].to_columns) == ("primary", ["a", "b"], [])
    assert (keys["fk"].kind, keys["fk"]["columns"], keys["fk"].to_table, keys["fk"].to_columns) == ("foreign", ["x", "y"], "order", ["a", "b"])
    assert readers.KEYS.keys() == readers.ESTIMATES.keys() == readers.DIALECTS.keys() and all("n_rows" in q for q in readers.ESTIMATES.values())


def test_entry_without_a_library(monkeypatch):
    """A library that the optional operators need is missing: all other queries are there, with a warning."""
    real = importlib.import_module

    def without(name, *args):
        if name == "tidemark.llm.catalog":
            raise ModuleNotFoundError("No module named 'ahocorasick'", name="ahocorasick")
        return real(name, *args)

    monkeypatch.setattr(importlib, "import_module", without)
    with pytest.warns(UserWarning, match="ahocorasick"):
        known = __spark_entry__.queries()
    assert "verification" in known and not any(n.startswith("op") and n[2].isdigit() for n in known) and "pipeline" not in known


def test_fixed_width_encodings(spark, tmp_path):
    fields = [readers.Field("id", "integer", 1, 3), readers.Field("name", "string", 4, 6)]
    for encoding in ("ISO-8859-1", "UTF-16LE", "UTF-8"):
        at = tmp_path / encoding
        at.write_bytes('001Zoë\\",\n002Ünal  \nxx\n'.encode(encoding))
        rows, rejects = readers.read_fixed_width(spark, str(at), fields, 9, encoding)
        assert [(r.id, r.name) for r in rows.orderBy("id").collect()] == [(1, 'Zoë\\",'), (2, "Ünal")] and [r.value for r in rejects.collect()] == ["xx"]


def test_consistency_is_said():
    assert readers.consistency("oracle", "repeatable").said() == "repeatable" and not readers.consistency("db2", "none", 8).downgraded
    assert readers.consistency("postgresql").downgraded and "asked for snapshot" in readers.consistency("postgresql").said()
    assert readers.consistency("sqlserver", "repeatable", partitions=8).said().startswith("none (asked for repeatable: 8 connections")
    assert readers.consistency("sqlserver", tables=2).strategy == "none"
    with pytest.raises(ValueError):
        readers.consistency("oracle", "magic")


class Asked:
    """Stands for a session: notes what a scan is asked for."""

    def __init__(self):
        self.options_, self.read = {}, self

    def format(self, kind):
        return self

    def options(self, **options):
        self.options_ |= options
        return self

    def load(self):
        return self


def test_read_consistent():
    session = Asked()
    _, how = readers.read_consistent(session, "oracle", "jdbc:x", "t", asked="repeatable")
    assert how.strategy == "repeatable" and session.options_["numPartitions"] == "1" and "SERIALIZABLE" in session.options_["sessionInitStatement"]
    session = Asked()
    _, how = readers.read_consistent(session, "oracle", "jdbc:x", "t", partition=("id", 1, 100, 8))
    assert how.downgraded and session.options_["numPartitions"] == "8" and "sessionInitStatement" not in session.options_

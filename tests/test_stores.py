"""Evidence, payload files and captures that notice what happened to them; ordered fingerprints; mergeable aggregates."""

import dataclasses
import glob
import hashlib
import os
import time
from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import ordered
from tidemark.operators import mergeable
from tidemark.plans import stored
from tidemark.sources import capture, evidence, payload_sink, readers, strict_json

FOUND = "check_id string, code string, stable_key string, dataset string, result string, severity string, expected string, actual string, detail string"


def findings(spark, n=40):
    return spark.createDataFrame([(f"c{i % 3}", "k", f"s{i}", "d", "fail" if i % 4 else "pass", "error", None, str(i), 'quote " é' if i % 7 == 0 else None) for i in range(n)], FOUND)


def test_evidence(spark, tmp_path):
    root = str(tmp_path / "ev")
    manifest = evidence.save(findings(spark).repartition(3), root, "r1")
    kept = evidence.load(spark, root, "r1")
    assert manifest["n_records"] == kept.count() == 41 and kept.where("kind = 'summary'").first().detail == '{"fail":30,"pass":10}'
    assert kept.select("evidence_id").distinct().count() == 41
    assert evidence.save(findings(spark), root, "r2")["fingerprint"] != manifest["fingerprint"]  # the run is part of a record
    with pytest.raises(Exception, match="already exists"):
        evidence.save(findings(spark), root, "r1")
    with pytest.raises(ValueError, match="one check"):
        evidence.save(findings(spark).union(findings(spark, 1)), root, "r3")
    part = next(p for p in glob.glob(f"{root}/r1/records/part-*") if '"finding"' in open(p).read())
    text = open(part).read()
    for changed in (text.replace('"fail"', '"pass"', 1), text.split("\n", 1)[1], text + text.split("\n")[0] + "\n", text.replace('"code":"k"', '"code":"k","code":"x"', 1)):
        assert changed != text
        open(part, "w").write(changed)
        for crc in glob.glob(f"{root}/r1/records/.*.crc"):
            os.remove(crc)
        with pytest.raises(Exception, match="not those that were written|repeated"):
            evidence.load(spark, root, "r1")
    open(part, "w").write(text)
    assert evidence.load(spark, root, "r1").count() == 41
    at = f"{root}/r2/manifest.json"
    told = open(at).read()
    open(at, "w").write(told.replace('"n_records": 41', '"n_records": 42'))
    for crc in glob.glob(f"{root}/r2/.*.crc"):
        os.remove(crc)
    with pytest.raises(ValueError, match="manifest"):
        evidence.load(spark, root, "r2")
    os.remove(at)
    with pytest.raises(ValueError, match="incomplete"):
        evidence.load(spark, root, "r2")


def test_evidence_is_parsed_once(spark, tmp_path):
    """Each record is parsed once, and what load returns is what was looked at, whatever happens to the files afterwards."""
    root = str(tmp_path / "ev")
    evidence.save(findings(spark), root, "r1")
    typed = strict_json.typed_records(spark, f"{root}/r1/records", T.StructType.fromDDL(evidence.RECORD), lines=True)
    assert typed._jdf.queryExecution().optimizedPlan().toString().count("parseJson") == 1
    kept = evidence.load(spark, root, "r1")
    before = sorted(map(tuple, kept.collect()), key=str)
    for part in glob.glob(f"{root}/r1/records/part-*"):
        text = open(part).read()
        open(part, "w").write(text.replace('"fail"', '"pass"'))
    for crc in glob.glob(f"{root}/r1/records/.*.crc"):
        os.remove(crc)
    assert sorted(map(tuple, kept.collect()), key=str) == before and len(before) == 41
    with pytest.raises(ValueError, match="not those"):
        evidence.load(spark, root, "r1")


def test_payload_files(spark, tmp_path):
    root = str(tmp_path / "target")
    files = spark.createDataFrame([(f"a/{i % 3}/{i}.bin", bytes([i]) * i) for i in range(31)], payload_sink.SCHEMA).repartition(4)
    payload_sink.write_payloads(files, root, "r1")
    listed = payload_sink.listed_payloads(spark, root, "r1")
    want = {(r.relative_path, len(r.content), r.h) for r in files.withColumn("h", F.sha2("content", 256)).collect()}
    assert {tuple(r) for r in listed.collect()} == want and payload_sink.lost_payloads(spark, root, "r1").isEmpty()
    assert not glob.glob(f"{root}/r1/_attempt*")
    with pytest.raises(Exception, match="there already"):
        payload_sink.write_payloads(files.limit(1), root, "r1")
    os.remove(f"{root}/r1/a/0/3.bin")
    open(f"{root}/r1/a/1/1.bin", "wb").write(b"other")
    open(f"{root}/r1/a/new.bin", "wb").write(b"more")
    assert {tuple(r) for r in payload_sink.lost_payloads(spark, root, "r1").collect()} == {("a/0/3.bin", "missing"), ("a/1/1.bin", "content"), ("a/new.bin", "unlisted")}


@pytest.mark.parametrize("bad", ["../x", "/x", "_x", "a//b", None])
def test_payload_files_abort(spark, tmp_path, bad):
    """A task fails: nothing stays, not even what other tasks have written."""
    root = str(tmp_path / "target")
    files = spark.createDataFrame([(f"{i}.bin", b"x") for i in range(20)] + [(bad, b"y")], payload_sink.SCHEMA).repartition(3)
    with pytest.raises(Exception, match="no path below"):
        payload_sink.write_payloads(files, root, "r1")
    time.sleep(1)  # tasks that were still at work notice by themselves
    assert [p for p in glob.glob(f"{root}/**", recursive=True) if os.path.isfile(p)] == []
    with pytest.raises(Exception, match="twice"):
        payload_sink.write_payloads(spark.createDataFrame([("a", b"1"), ("a", b"2")], payload_sink.SCHEMA).repartition(2), root, "r2")
    assert [p for p in glob.glob(f"{root}/**", recursive=True) if os.path.isfile(p)] == []


def test_payloads_read_by_their_list(spark, tmp_path, monkeypatch):
    """Empty and null contents come back, a move that fails leaves nothing, and the driver moves no file and lists none."""
    root = str(tmp_path / "target")
    rows = [(f"a/{i}", b"x" * i) for i in range(5)] + [("b/null", None)]
    files = spark.createDataFrame(rows, payload_sink.SCHEMA).repartition(3)
    payload_sink.write_payloads(files, root, "r1")
    got = {r.relative_path: (r.length, r.sha256) for r in payload_sink.read_payloads(spark, root, "r1").collect()}
    assert got == {p: (None, None) if c is None else (len(c), hashlib.sha256(c).hexdigest()) for p, c in rows}
    assert sorted(os.path.basename(p) for p in glob.glob(f"{root}/r1/**", recursive=True) if os.path.isfile(p)) == list("01234")
    assert payload_sink.lost_payloads(spark, root, "r1").isEmpty()
    os.remove(f"{root}/r1/a/0")
    with pytest.raises(Exception, match="a/0"):
        payload_sink.read_payloads(spark, root, "r1").collect()
    driver = os.getpid()

    def fails_late(store, source, target, made, move=payload_sink._move):
        assert os.getpid() != driver
        if target.endswith("/3"):
            time.sleep(0.5)
            raise OSError("no move")
        return move(store, source, target, made)

    monkeypatch.setattr(payload_sink, "_move", fails_late)
    with pytest.raises(Exception, match="no move"):
        payload_sink.write_payloads(files, root, "r2")
    assert [p for p in glob.glob(f"{root}/r2*/**", recursive=True) if os.path.isfile(p)] == []


def test_payload_round_trip_of_odd_texts(spark, tmp_path):
    """Documents with an empty and a null text against the SQL."""
    docs = spark.createDataFrame([(1, "é"), (2, ""), (3, None), (4, " \n")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {tuple(r) for r in stored.QUERIES["payload_round_trip"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == set(con.sql(stored.SQL["payload_round_trip"]).fetchall()) and len(got) == 4


def test_payloads_without_a_list_on_the_driver(spark, sf_dir, monkeypatch):
    """The driver holds no list of files: only tasks move, and no reader lists the run's folder."""
    monkeypatch.setattr(readers, "read_files", None)
    monkeypatch.setattr(payload_sink, "_read", lambda store, at, read=payload_sink._read, driver=os.getpid(): read(store, at) if os.getpid() != driver else 1 / 0)
    assert stored.QUERIES["payload_round_trip"](spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


def test_capture_of_files_that_change(spark, tmp_path):
    src, root = tmp_path / "src", str(tmp_path / "cap")
    src.mkdir()
    (src / "a.csv").write_text("id,v\n1,x\n")
    (src / "b.csv").write_text("id,v\n2,y\n")
    read = lambda s, p: readers.read_csv(s, p)
    capture.capture_files(spark, str(src), read, root, "c1", "d")
    assert capture.replay(spark, root, "c1", "d").count() == 2 and capture.changed_since(spark, str(src), root, "c1", "d").isEmpty()

    def replaced(s, p):
        df = readers.read_csv(s, p)
        time.sleep(0.05)
        (src / "b.csv").write_text("id,v\n2,z\n3,w\n")
        return df

    with pytest.raises(ValueError, match="b.csv: changed"):
        capture.capture_files(spark, str(src), replaced, root, "c2", "d")
    assert not os.path.exists(f"{root}/c2")
    assert [os.path.basename(r.path) for r in capture.changed_since(spark, str(src), root, "c1", "d").collect()] == ["b.csv"]


def test_ordered_fingerprint(spark):
    rows = [(i * 37 % 20_000 - 9_000, f"n{i}", Decimal(i)) for i in range(6_000)]
    df = spark.createDataFrame(rows, "id long, name string, pay decimal(12,2)")
    one = ordered.ordered_fingerprint(df, ["id"])
    assert one == ordered.ordered_fingerprint(df.repartition(7).orderBy("name"), ["id"]) != ordered.ordered_fingerprint(df, ["name", "id"])
    assert ordered.divergent_ranges(df, df.repartition(5), ["id"]).isEmpty() and ordered.ordered_fingerprint(df.limit(0), ["id"]) == ""
    k, gone, other = F.col("id"), rows[10][0], rows[4_000][0]
    after = df.where(k != gone).withColumn("name", F.when(k == other, "other").otherwise(F.col("name"))).union(spark.createDataFrame([(500_000, "new", None)], df.schema))
    got = {r.range: (r.n_before, r.n_after) for r in ordered.divergent_ranges(df, after, ["id"]).collect()}
    digits = lambda i: f"{(i + (1 << 63)):016x}"[:13]
    n = lambda i, of: sum(digits(r) == digits(i) for r in of)
    ids = [r[0] for r in rows]
    assert got == {digits(gone): (n(gone, ids), n(gone, ids) - 1), digits(other): (n(other, ids),) * 2, digits(500_000): (0, 1)} and len(got) == 3
    swapped = df.withColumn("name", F.when(k == gone, F.lit("n4000")).when(k == other, F.lit("n10")).otherwise(F.col("name")))
    assert ordered.ordered_fingerprint(swapped, ["id"]) != one


def test_sortable(spark):
    df = spark.sql("SELECT * FROM VALUES (-5L, DATE '1960-01-01', TIMESTAMP '1950-01-01 00:00:00', -1.5BD, 'a'), (0L, DATE '1970-01-01', TIMESTAMP '1970-01-01 00:00:00', 0.0BD, 'ab'), (7L, DATE '2024-01-01', TIMESTAMP '2024-01-01 00:00:00', 2.5BD, 'b') t(k, d, t, m, s)")
    for c in df.columns:
        texts = [r.x for r in df.select(c, ordered.sortable(F.col(c), df.schema[c].dataType).alias("x")).orderBy(c).collect()]
        assert texts == sorted(texts) and len(set(texts)) == 3 and {len(x) for x in texts} == {16}
    with pytest.raises(TypeError):
        ordered.sortable(F.lit(1.0), df.selectExpr("CAST(1 AS DOUBLE) AS x").schema["x"].dataType)


@pytest.mark.parametrize("held", [1, 1000])
def test_mergeable(spark, held):
    rows = [(None if i % 5 == 0 else f"g{i % 3}", i % 2, None if i % 11 == 0 else float(i % 70 - 5)) for i in range(2_000)]
    df = spark.createDataFrame(rows, "g string, h int, v double").repartition(6)
    out = mergeable.merged(df, ["g", "h"], mergeable.histogram("v", 0, 10, 5), salts=3, held=held).collect()
    want = {}
    for g, h, v in rows:
        counts = want.setdefault((g, h), [0] * 6)
        counts[5 if v is None else min(4, max(0, int(v // 10)))] += 1
    assert {(r.g, r.h): r.counts for r in out} == want and len(out) == len(want)
    assert mergeable.merged(df.limit(0), ["g"], mergeable.histogram("v", 0, 10, 5)).count() == 0
    moved = df.withColumn("v", F.when((F.col("g") == "g1") & (F.col("h") == 1), F.lit(65.0)).otherwise(F.col("v"))).where("g IS NULL OR g <> 'g2'")
    drift = {r.g: r.distance for r in mergeable.distribution_drift(df, moved, ["g"], mergeable.histogram("v", 0, 10, 5)).collect()}
    assert drift[None] == 0 and drift["g0"] == 0 and 0.3 < drift["g1"] < 0.6 and drift["g2"] == 1


def test_mergeable_one_by_one(spark, monkeypatch):
    """Many groups of few rows: the same from states that are made and merged one by one and at once; no group is a Python call of its own."""
    from pyspark.sql.group import GroupedData

    monkeypatch.setattr(GroupedData, "applyInArrow", None)
    at_once = mergeable.histogram("v", 0, 10, 5)
    single = dataclasses.replace(at_once, partials=None, merges=None, finishes=None)
    k = F.col("id")
    df = spark.range(0, 30_000, 1, 5).select(F.when(k % 7 != 0, k % 4_001).alias("g"), F.when(k % 3 == 0, -0.0).when(k % 3 == 1, 0.0).otherwise(F.lit("NaN").cast("double")).alias("h"), F.when(k % 11 != 0, (k % 70 - 5).cast("double")).alias("v"))
    want = {}
    for r in df.select("g", F.when(F.isnan("h"), "n").otherwise("z").alias("h"), "v").collect():
        counts = want.setdefault((r.g, r.h), [0] * 6)
        counts[5 if r.v is None else min(4, max(0, int(r.v // 10)))] += 1
    for how in (at_once, single):
        for held in (100, 100_000):
            out = mergeable.merged(df, ["g", "h"], how, salts=3, held=held).collect()
            assert {(r.g, "n" if r.h != r.h else "z"): r.counts for r in out} == want and len(out) == len(want)

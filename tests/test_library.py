"""Mappings, checks, sources, captures, runs and the stream on hand-made frames with known faults."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.functions.columns import code_map
from tidemark.operators import profile, reconcile, runs, timelines, totals
from tidemark.plans.checks import CHECKS, PACKS, Check, Context, verify
from tidemark.plans.mapping import Edge, Plan, expected_state
from tidemark.plans.scope import Predicate, Scope
from tidemark.sources import capture, readers
from tidemark.streaming.continuous import verify_stream


def people(spark):
    return spark.createDataFrame([(1, "a", "1990-01-01", Decimal("1.00")), (2, "b", "x", Decimal("2.00")), (3, None, None, None)], "id long, name string, born string, pay decimal(10,2)")


def test_clean_data_has_no_faults(spark):
    df = people(spark)
    ctx = Context({"p": df}, {"p": df.repartition(3)})
    common = {"dataset": "p", "keys": ["id"]}
    found = verify(ctx, [Check("1", "presence", common), Check("2", "no_unexpected", common), Check("3", "values", common | {"fields": ["name", "pay"]}), Check("4", "uniqueness", common), Check("5", "keyed", common | {"fields": ["name"]})])
    assert {r.result for r in found.collect()} == {"pass"} and found.count() == 5


def test_seeded_faults(spark):
    e = people(spark)
    a = spark.createDataFrame([(1, "a", "", Decimal("1.02")), (1, "a", "", Decimal("1.02")), (3, "c", "", None), (9, "z", "", None)], e.schema)
    assert [r.id for r in reconcile.missing(e, a, ["id"]).collect()] == [2]
    assert [r.id for r in reconcile.unexpected(e, a, ["id"]).collect()] == [9]
    assert [(r.id, r.n) for r in reconcile.repeated(a, ["id"]).collect()] == [(1, 2)]
    assert [(r.id, r.field, r.expected, r.actual) for r in reconcile.mismatches(e, a, ["id"], ["name", "pay"]).collect()] == [(3, "name", None, "c")]
    codes = {(r.id, r.code) for r in reconcile.keyed(e, a, ["id"], ["name"], "pay", Decimal("0.01")).collect()}
    assert codes == {(1, "repeated"), (1, "amount"), (2, "missing"), (3, "amount")}
    with pytest.raises(TypeError):
        reconcile.mismatches(e, a.withColumn("pay", F.col("pay").cast("string")), ["id"], ["pay"])
    with pytest.raises(TypeError):
        reconcile.mismatches(e, a.drop("pay"), ["id"], ["pay"])


def test_presence_of_nothing(spark):
    df = people(spark)
    found = verify(Context({"p": df.limit(0)}, {"p": df}), [Check("1", "presence", {"dataset": "p", "keys": ["id"]})])
    assert [r.code for r in found.collect()] == ["nothing_expected"]
    with pytest.raises(ValueError):
        verify(Context({"p": df}, {"p": df}), [Check("1", "nonsense")])
    assert all(c in CHECKS for p in PACKS.values() for c in p["checks"])


def test_totals(spark):
    t = spark.createDataFrame([(1, "1.5"), (2, None), (3, "abc")], "id long, v string")
    r = totals.exact_total(t, "v", "id").first()
    assert (r.total, r.n_invalid, r.first_invalid, r.overflowed) == (Decimal("1.50"), 2, 2, False)
    big = spark.createDataFrame([(1, "9" * 36), (2, "9" * 36)], "id long, v string")
    assert totals.exact_total(big, "v", "id").first().n_invalid == 0
    g = lambda on: {(r.k, r.code) for r in totals.grouped_totals(spark.createDataFrame([("x", None), (None, "2")], "k string, v string"), spark.createDataFrame([("x", "0"), (None, "3")], "k string, v string"), ["k"], "v", on_invalid=on).collect()}
    assert g("zero") == {(None, "total")} and g("fail") == {("x", "invalid"), (None, "total")}
    with pytest.raises(Exception, match="null"):
        g("raise")


def test_timelines(spark):
    rows = [("a", 1, "2020-01-01", "2020-01-31"), ("a", 2, "2020-01-15", None), ("a", 3, "2020-03-01", "2020-02-01"), ("a", 4, None, None), ("b", 5, "2020-01-01", "2020-01-10"), ("b", 6, "2020-01-20", "2020-01-25")]
    df = spark.createDataFrame(rows, "o string, id int, s string, e string").withColumns({"s": F.to_date("s"), "e": F.to_date("e")})
    got = {(r.id, r.code) for r in timelines.interval_faults(df, "o", "s", "e", "id", continuous=True).collect()}
    assert got == {(4, "no_start"), (3, "reversed"), (1, "after_open"), (2, "overlap"), (6, "gap")}
    skipped = {(r.id, r.code) for r in timelines.interval_faults(df, "o", "s", "e", "id", skip_invalid=True).collect()}
    assert skipped == {(4, "no_start"), (3, "reversed"), (2, "overlap")}
    assert {(r.o, r.n) for r in timelines.as_of_faults(df, "o", "s", "e", "2020-01-20").collect()} == {("a", 2)}


def test_mapping(spark):
    upper = F.upper
    plan = Plan(
        (Edge("a", "people", ("member",), "map", {"id": ("id", ()), "label": ("name", (upper,)), "born": ("born", (lambda c: c.try_cast("date"),))}), Edge("b", "member", ("archive",), "archive"), Edge("r", "people", (), "relationship")),
        {"people": ("id",), "member": ("id",), "archive": ("id",)},
    )
    made, rejects, journal = expected_state(plan, {"people": people(spark)}, on_reject="keep")
    assert {(r.id, r.label) for r in made["archive"].collect()} == {(1, "A"), (3, None)}
    assert [(r._edge, r.field) for r in rejects.collect()] == [("a", "born")]
    assert sorted(r.result for r in journal.collect()) == ["failed", "metadata", "produced", "produced", "produced", "produced"]
    with pytest.raises(Exception, match="cannot map born"):
        expected_state(plan, {"people": people(spark)})[0]["member"].collect()
    for read in (lambda df: df.select("id", "label").collect(), lambda df: df.count()):
        with pytest.raises(Exception, match="cannot map born"):
            read(expected_state(plan, {"people": people(spark)})[0]["member"])
    assert plan.digest() == Plan(plan.edges[::-1], plan.keys).digest()
    recode = lambda codes: Plan((Edge("a", "people", ("m",), "map", {"id": ("id", (lambda c: code_map(c, codes),))}),), {"people": ("id",), "m": ("id",)}).digest()
    assert recode({"A": "a"}) == recode({"A": "a"}) != recode({"A": "other"})
    for operation in ("derive", "merge", "aggregate"):
        with pytest.raises(ValueError, match=operation):
            Edge("x", "people", ("one",), operation)
    with pytest.raises(ValueError):
        Edge("x", "people", ("one",), "split")
    with pytest.raises(ValueError):
        expected_state(Plan((Edge("x", "people", ("m",), "map", {"q": ("nope", ())}),), plan.keys | {"m": ("q",)}), {"people": people(spark)})


def test_scope(spark):
    df = people(spark)
    assert Scope("s", (Predicate("in", "id", ("1", "2")), Predicate("not_null", "name"))).apply(df).count() == 2
    with pytest.raises(ValueError):
        Scope("s", (Predicate("range", "id", ("2", "1")),)).apply(df)
    with pytest.raises(Exception):
        Scope("s", (Predicate("equals", "id", ("abc",)),)).apply(df).count()
    assert Scope("s", (Predicate("in", "id", ("1", "2")),)).digest() == Scope("s", (Predicate("in", "id", ("2", "1")),)).digest()


def test_runs(spark):
    f = lambda *rows: spark.createDataFrame([("r", c, k, "d", s, "fail", "error") for c, k, s in rows], "run_id string, check_id string, code string, dataset string, stable_key string, result string, severity string")
    before, after = f(("1", "m", "a"), ("1", "m", "b"), ("2", "m", "c"), ("2", "m", "c")), f(("1", "m", "a"), ("1", "m", "x"), ("2", "m", "c"), ("3", "m", "n"))
    delta = {(r.check_id, r.stable_key, r.change) for r in runs.run_delta(before, after).collect()}
    assert delta == {("1", "a", "persisting"), ("1", "x", "changed"), ("2", "c", "persisting"), ("2", "c", "resolved"), ("3", "n", "added")}
    same = runs.delta_summary(runs.run_delta(before, before))
    assert runs.baseline_class(same, True, True).first()["class"] == "equivalent"
    assert runs.outcome(before).first().outcome == "failed" and runs.outcome(before.limit(0)).first().outcome == "passed"
    assert not runs.qualification(runs.outcome(before), True, True).first().qualified
    notes = spark.createDataFrame([("1", "m", "d", "known"), ("9", "m", "d", "stale")], "check_id string, code string, dataset string, reason string")
    assert runs.annotate(before, notes).count() == before.count() and [r.reason for r in runs.unmatched_annotations(before, notes).collect()] == ["stale"]
    assert [r.n for r in runs.repeated_evidence(before).collect()] == [2]


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id;name\n1;x\n2;\n")
    assert [tuple(r) for r in readers.read_csv(spark, str(tmp_path / "a.csv"), ";").collect()] == [("1", "x"), ("2", None)]
    (tmp_path / "b.csv").write_text("id,id\n1,2\n")
    with pytest.raises(ValueError):
        readers.read_csv(spark, str(tmp_path / "b.csv"))
    (tmp_path / "n.json").write_text('{"a":1,"b":{"c":"2"}}\nbroken\n')
    rows = readers.read_json(spark, str(tmp_path / "n.json"), "a int, b struct<c:string>", lines=True, rejects=True).collect()
    assert [r.a for r in rows if r._corrupt_record is None] == [1] and len(rows) == 2
    with pytest.raises(Exception):
        readers.read_json(spark, str(tmp_path / "n.json"), "a int", lines=True).collect()
    (tmp_path / "x.xml").write_text("<r><p><id>1</id></p><p><id>2</id></p></r>")
    assert readers.read_xml(spark, str(tmp_path / "x.xml"), "p", "id int").count() == 2
    (tmp_path / "f.txt").write_text("001ab 2024\n002cd x\nshort\n")
    good, bad = readers.read_fixed_width(spark, str(tmp_path / "f.txt"), [readers.Field("id", "integer", 1, 3), readers.Field("name", "string", 4, 2), readers.Field("year", "integer", 7, 4)], 10)
    assert [(r.id, r.name, r.year) for r in good.collect()] == [(1, "ab", 2024)] and bad.count() == 2
    with pytest.raises(ValueError):
        readers.read_fixed_width(spark, str(tmp_path / "f.txt"), [readers.Field("a", start=1, length=3), readers.Field("b", start=3, length=2)], 10)
    people(spark).write.parquet(str(tmp_path / "p"))
    assert readers.read_parquet(spark, str(tmp_path / "p"), ["id"]).columns == ["id"]
    with pytest.raises(TypeError):
        readers.guard_flat(spark.createDataFrame([], "a array<int>").schema)
    with pytest.raises(TypeError):
        readers.guard_flat(spark.createDataFrame([], "a decimal(38,2)").schema)
    with pytest.raises(ValueError):
        readers.pick(people(spark), ["nope"])
    options = readers.jdbc_options("oracle", "jdbc:x", "t", partition=("id", 1, 100, 8), decimals={"V": "DECIMAL(38,6)"})
    assert options["numPartitions"] == "8" and options["customSchema"] == "V DECIMAL(38,6)"
    assert readers.jdbc_options("db2", "jdbc:x", "t", consistent=True)["numPartitions"] == "1"


def test_files_and_captures(spark, tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/sub/a.bin").write_bytes(b"one")
    (tmp_path / "in/b.txt").write_bytes(b"one")
    files = readers.read_files(spark, str(tmp_path / "in"), "**/*.bin")
    assert [(r.relative_path, r.length) for r in files.collect()] == [("sub/a.bin", 3)]
    before = [tuple(r) for r in readers.listing(spark, str(tmp_path / "in")).collect()]
    (tmp_path / "in/b.txt").write_bytes(b"more")
    was = spark.createDataFrame(before, "path string, length long, modified timestamp")
    assert readers.changed_files(was, readers.listing(spark, str(tmp_path / "in"))).count() == 1
    capture.store_payloads(readers.read_files(spark, str(tmp_path / "in")), str(tmp_path / "blobs"))
    assert capture.corrupt_payloads(spark, str(tmp_path / "blobs")).count() == 0
    df = people(spark)
    m = capture.capture(spark, {"p": df}, str(tmp_path / "cap"), "c1")
    assert capture.replay(spark, str(tmp_path / "cap"), "c1", "p").count() == 3 and capture.capture_summary(m).first().n_rows == 3
    m2 = capture.capture(spark, {"p": df.repartition(3)}, str(tmp_path / "cap"), "c2")
    assert capture.captures_equal(m, m2)
    df.limit(1).write.mode("append").parquet(str(tmp_path / "cap/c1/p"))
    with pytest.raises(ValueError):
        capture.replay(spark, str(tmp_path / "cap"), "c1", "p")
    capture.write_ledger(str(tmp_path / "ledger"), "r1", journal=df)
    capture.write_ledger(str(tmp_path / "ledger"), "r2", journal=df.limit(1))
    capture.write_ledger(str(tmp_path / "ledger"), "r1", journal=df.limit(2))
    assert capture.ledger_counts(str(tmp_path / "ledger"), spark, "r1", "journal") == {"journal": 2} and capture.ledger_counts(str(tmp_path / "ledger"), spark, "r2", "journal") == {"journal": 1}
    assert {(r.id, r.code) for r in readers.bad_keys(df.union(df.limit(1)).union(spark.createDataFrame([(None, "q", "", None)], df.schema)), ["id"]).collect()} == {(1, "repeated"), (None, "null")}


def test_profile(spark):
    p = {r.field: (r.n_rows, r.n_null, r.n_empty) for r in profile.profile(people(spark), "p").collect()}
    assert p["name"] == (3, 1, 0) and p["id"] == (3, 0, 0)
    kinds = spark.createDataFrame([("1", "1.5", "2020-01-01", "p", "1", ""), ("2", "2", "2020-01-02", "q", "z", None)], "a string, b string, c string, d string, e string, f string")
    assert [r.inferred for r in profile.inferred_types(kinds, list("abcdef")).collect()] == ["integer", "decimal", "date", "string", "mixed", "empty"]


def test_stream(spark, tmp_path):
    df = people(spark)
    df.write.parquet(str(tmp_path / "in"))
    q = verify_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), {"p": df}, "p", [Check("1", "no_unexpected", {"dataset": "p", "keys": ["id"]})], str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(60)
    assert {r.result for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"pass"}


def test_checks_on_repeats_maps_and_redaction(spark):
    frame = lambda rows: spark.createDataFrame(rows, "id long, status string, at string, hash string, owner string")
    e = frame([(1, "A", "2024-01-01T00:00:00Z", "ab", "x"), (2, "B", "2024-01-02T00:00:00Z", "cd", "x"), (2, "B", "2024-01-03T00:00:00Z", "cd", "x"), (3, "C", None, "ef", "y"), (4, "A", "2024-01-05T00:00:00Z", "aa", "z")])
    a = frame([(1, "active", "2024-01-01T00:00:00Z", "AB", "x"), (1, "active", "2024-01-01T00:00:00Z", "zz", "x"), (2, "blocked", "2024-01-02T00:00:00Z", "cd", "x"), (2, "blocked", "2024-01-03T00:00:00+01:00", "cd", "x"), (4, "active", "2024-01-05T00:00:00Z", "AA", "z")])
    found = lambda kind, redact=False, **options: {(r.stable_key, r.code, r.expected, r.actual) for r in verify(Context({"t": e}, {"t": a}, redact=redact), [Check("c", kind, {"dataset": "t", **options})]).collect()}
    codes = lambda *x, **y: sorted(f[1] for f in found(*x, **y))
    assert codes("digests", keys=["id"], hashed="hash") == ["content", "missing", "repeated", "repeated"]
    assert codes("same_instant_text", keys=["id"], at="at") == ["text"]
    assert codes("values", keys=["id"], fields=["status"], maps={"status": {"A": "active", "B": "blocked"}}) == ["clean"]
    assert codes("event_positions", owner="owner", order=["at"], date="at", code="status") == ["code", "code", "date", "date", "extra", "missing"]
    raw, hidden = found("values", keys=["id"], fields=["status"]), found("values", True, keys=["id"], fields=["status"])
    assert {x[3] for x in raw} == {"active"} and all(x[2].startswith("sha256:") and x[3].startswith("sha256:") for x in hidden)


def test_numbers_of_a_large_group(spark):
    rows = [("c", None if i % 3 else "d", f"{i * 7919 % 1000:03d}-{i}") for i in range(300)] + [("c", "d", None), ("c", "d", "")]
    df = spark.createDataFrame(rows, "check_id string, dataset string, stable_key string")
    for prefix in (1, 4):
        got = runs._numbered(df, ["check_id", "dataset"], "stable_key", prefix).collect()
        for d in (None, "d"):
            mine = sorted((r for r in got if r.dataset == d), key=lambda r: r.rn)
            assert [r.rn for r in mine] == list(range(1, len(mine) + 1))
            keys = [r.stable_key for r in mine]
            assert keys == sorted((k for _, x, k in rows if x == d), key=lambda k: (k is not None, k or ""))

"""Segmented prefix scans against plain loops, on orders that one owner holds all of, and the operators built on them."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import reconcile, scan, timelines
from tidemark.operators.scan import State, before_each, numbered
from tidemark.plans import catalog


def readings(n=900, seed=3):
    rng = random.Random(seed)
    owner = lambda i: "big" if i % 3 else rng.choice([None, "b", "c", "also large"])
    return [(owner(i), rng.choice([None, *range(200)]), i, rng.choice([None, rng.randint(0, 9)]), rng.random() < 0.5) for i in range(n)]


@pytest.mark.parametrize("rows", [5, 40, 10_000])
def test_before_each(spark, rows):
    data = readings()
    df = spark.createDataFrame(data, "o string, at int, id int, v int, on boolean").repartition(5)
    states = {"last_v": State("last", F.col("v")), "prev": State("last", F.struct("v", "id")), "top": State("max", F.col("v")), "ever": State("max", F.col("on")), "total": State("sum", F.col("v")), "seen": State("sum", F.lit(1))}
    got = {r.id: r for r in before_each(df, ["o"], [F.col("at").asc_nulls_first(), "id"], states, rows).collect()}
    assert len(got) == len(data)
    for o in {r[0] for r in data}:
        mine, earlier = sorted((r for r in data if r[0] == o), key=lambda r: (r[1] is not None, r[1] or 0, r[2])), []
        for r in mine:
            known = [x[3] for x in earlier if x[3] is not None]
            want = (known[-1] if known else None, (earlier[-1][3], earlier[-1][2]) if earlier else None, max(known, default=None), max((x[4] for x in earlier), default=None), sum(known) if known else None, len(earlier) or None)
            x = got[r[2]]
            assert (x.last_v, x.prev and tuple(x.prev), x.top, x.ever, x.total, x.seen) == want
            earlier.append(r)


def test_no_task_reads_more_than_its_share(spark):
    """One owner with all rows: after the cut, every range holds about a segment of them."""
    df = spark.range(20_000).select(F.lit("one").alias("o"), F.col("id"), (F.col("id") * 7919 % 20_000).alias("at"))
    out = numbered(df, ["o"], ["at"], rows=1_000)
    assert out.where("rn <> at + 1").isEmpty()
    plan = out._jdf.queryExecution().toString()
    ranged = spark.read.parquet(next(p for p in out.inputFiles()).rpartition("/")[0])
    sizes = [r.n for r in ranged.groupBy(F.shiftright("_place", 33)).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) >= 20 and max(sizes) < 2_000 and "_range" in plan


@pytest.mark.parametrize("name", ["interval_check", "state_changes", "positional_events", "sequence_monotonic", "positional_pairs", "duplicate_after_first", "typed_equality"])
def test_queries_in_segments(name, spark, sf_dir, monkeypatch):
    """The catalogue's queries give the same rows when every owner of some size is cut."""
    query = catalog.queries()[name]
    whole = query(spark, sf_dir)
    want = sorted(map(str, whole.collect()))
    monkeypatch.setattr(scan, "SEGMENT_ROWS", 7)
    assert sorted(map(str, query(spark, sf_dir).collect())) == want and want


def test_operators_on_one_owner(spark, monkeypatch):
    rows = [("a", i, f"2020-01-{1 + i % 28:02d}", None if i % 9 == 0 else f"2020-01-{1 + (i * 5) % 28:02d}") for i in range(200)]
    df = spark.createDataFrame(rows, "o string, id int, s string, e string").withColumns({"s": F.to_date("s"), "e": F.to_date("e")})
    for options in ({}, {"running_end": True}, {"skip_invalid": True, "continuous": True}):
        run = lambda: sorted(map(tuple, timelines.interval_faults(df, "o", "s", "e", "id", **options).collect()))  # noqa: B023, E731
        monkeypatch.setattr(scan, "SEGMENT_ROWS", 1_000_000)
        want = run()
        monkeypatch.setattr(scan, "SEGMENT_ROWS", 11)
        assert run() == want and want
    again = reconcile.repeats_after_first(df.withColumn("rn", F.lit("clash")).drop("rn"), ["o"], [F.col("id")])
    assert sorted(r.rn for r in again.collect()) == list(range(2, 201))

"""Captures of datasets, their replay, and what a run leaves behind."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.canonical import set_fingerprint
from tidemark.schema import CAPTURE
from tidemark.shared import remove, written
from tidemark.sources.readers import changed_files, listing


def capture(spark: SparkSession, datasets: dict[str, DataFrame], root: str, capture_id: str, scope_id: str = "full", consistency: str = "none") -> DataFrame:
    """Write every dataset below root and a manifest row for each; returns the manifest. An existing capture is an error."""
    rows = []
    for name, df in datasets.items():
        start, at = datetime.now(timezone.utc), f"{root}/{capture_id}/{name}"
        df.write.mode("errorifexists").parquet(at)
        kept = spark.read.parquet(at)
        size = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(at).agg(F.sum("length")).first()[0]
        rows.append((capture_id, name, kept.count(), int(size or 0), set_fingerprint(kept, name), scope_id, consistency, start, datetime.now(timezone.utc)))
    manifest = spark.createDataFrame(rows, CAPTURE)
    manifest.coalesce(1).write.mode("errorifexists").parquet(f"{root}/{capture_id}/_manifest.parquet")
    return manifest


def capture_files(spark: SparkSession, path: str, read: Callable[[SparkSession, str], DataFrame], root: str, capture_id: str, dataset: str, scope_id: str = "full") -> DataFrame:
    """Capture a dataset that lies in files, read by ``read(spark, path)``; returns the manifest.

    The files are pinned: they are listed (path, length, time) before the read and again when all is written.
    A difference is an error, and nothing of the capture stays.
    """
    before = written(listing(spark, path))
    if before.isEmpty():
        raise ValueError(f"{path}: no files")
    manifest = capture(spark, {dataset: read(spark, path)}, root, capture_id, scope_id, "files pinned")
    changed = changed_files(before, listing(spark, path)).orderBy("path").first()
    if changed:
        remove(spark, f"{root}/{capture_id}")
        raise ValueError(f"{changed['path']}: changed while it was read")
    before.orderBy("path").coalesce(1).write.mode("errorifexists").parquet(f"{root}/{capture_id}/_files-{dataset}.parquet")
    return manifest


def changed_since(spark: SparkSession, path: str, root: str, capture_id: str, dataset: str) -> DataFrame:
    """Files that came, went or changed since a capture of them."""
    return changed_files(spark.read.parquet(f"{root}/{capture_id}/_files-{dataset}.parquet"), listing(spark, path))


def replay(spark: SparkSession, root: str, capture_id: str, dataset: str) -> DataFrame:
    """A captured dataset, after its fingerprint was found to be that of the manifest."""
    row = spark.read.parquet(f"{root}/{capture_id}/_manifest.parquet").where(F.col("dataset") == dataset).first()
    if row is None:
        raise ValueError(f"{capture_id}: no dataset {dataset!r}")
    df = spark.read.parquet(f"{root}/{capture_id}/{dataset}")
    if set_fingerprint(df, dataset) != row["fingerprint"]:
        raise ValueError(f"{capture_id}: {dataset} is not what was captured")
    return df


def capture_summary(manifest: DataFrame) -> DataFrame:
    """One row: datasets, rows, bytes, skew_seconds between the first and last capture."""
    seconds = lambda c: F.unix_micros(c) / 1e6
    return manifest.agg(F.count(F.lit(1)).alias("n_datasets"), F.sum("n_rows").alias("n_rows"), F.sum("n_bytes").alias("n_bytes"), (seconds(F.max("completed_at")) - seconds(F.min("completed_at"))).alias("skew_seconds"))


def captures_equal(before: DataFrame, after: DataFrame) -> bool:
    """Whether two manifests agree in all but incidental fields."""
    fields = ["dataset", "n_rows", "fingerprint", "scope_id", "consistency"]
    b, a = before.select(*fields), after.select(*fields)
    return b.exceptAll(a).isEmpty() and a.exceptAll(b).isEmpty()


def store_payloads(files: DataFrame, path: str) -> None:
    """Payloads once by digest."""
    files.select("sha256", "content").dropDuplicates(["sha256"]).write.mode("errorifexists").parquet(path)


def corrupt_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Stored payloads whose content no longer has its digest."""
    return spark.read.parquet(path).where(F.sha2("content", 256) != F.col("sha256")).select("sha256")


def write_target(df: DataFrame, root: str, run_id: str, dataset: str) -> str:
    """A projected target, apart for each run."""
    at = f"{root}/{run_id}/{dataset}"
    df.write.mode("errorifexists").parquet(at)
    return at


def write_ledger(root: str, run_id: str, **tables: DataFrame) -> None:
    """Findings, journal, dispositions and lineage, partitioned by run; writing a run again replaces that run."""
    for name, df in tables.items():
        df.drop("run_id").withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(f"{root}/{name}")


def read_ledger(spark: SparkSession, root: str, table: str, run_id: str | None = None) -> DataFrame:
    df = spark.read.parquet(f"{root}/{table}")
    return df.where(F.col("run_id") == run_id) if run_id else df


def ledger_counts(root: str, spark: SparkSession, run_id: str, *tables: str) -> dict[str, int]:
    return {t: read_ledger(spark, root, t, run_id).count() for t in tables}


def ledger_fingerprints(root: str, spark: SparkSession, run_id: str, *tables: str) -> dict[str, str]:
    """The set fingerprint of each of a run's tables."""
    return {t: set_fingerprint(read_ledger(spark, root, t, run_id).drop("run_id"), t) for t in tables}


def same_state(expected: DataFrame, observed: DataFrame, dataset: str) -> bool:
    """Whether an observed target is the recorded one: equal fingerprints, which hold the counts too."""
    return set_fingerprint(expected, dataset) == set_fingerprint(observed.select(*expected.columns), dataset)

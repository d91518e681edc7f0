"""Evidence of runs, kept so that a later reader can tell whether it is what was written.

A run's records are NDJSON, written by Spark's committer (a failed task or job
leaves no record behind), and a manifest that comes last, by a rename: a run
without one is incomplete. The manifest holds the number of records, their set
fingerprint, taken while they were written, and a digest over itself.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.canonical import LANES, row_fingerprint
from tidemark.functions.columns import evidence_id
from tidemark.shared import observed
from tidemark.sources import strict_json

# Fixed value: the format's name in the manifest.
FORMAT = "evidence/1"
RECORD = "evidence_id string, kind string, run_id string, check_id string, code string, stable_key string, dataset string, result string, severity string, expected string, actual string, detail string"


def records(found: DataFrame, run_id: str) -> DataFrame:
    """A run's findings as evidence records, and one more that sums them up (kind summary: counts by result in detail)."""
    if not found.groupBy("check_id", "code", "stable_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        raise ValueError(f"{run_id}: two findings have one check, code and stable key")
    named = found.withColumn("run_id", F.lit(run_id))
    kinds = [f.name for f in T.StructType.fromDDL(RECORD).fields]
    each = named.select(evidence_id(F.col("run_id"), F.concat_ws("/", "check_id", "code"), F.col("stable_key")).alias("evidence_id"), F.lit("finding").alias("kind"), *kinds[2:])
    counts = named.groupBy("result").agg(F.count(F.lit(1)).alias("n"))
    text = F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("result", "n")))))
    none = lambda c: F.lit(None).cast("string").alias(c)
    summary = counts.agg(text.alias("detail")).select(evidence_id(F.lit(run_id), F.lit("summary"), F.lit("")).alias("evidence_id"), F.lit("summary").alias("kind"), F.lit(run_id).alias("run_id"), *[none(c) for c in kinds[3:-1]], "detail")
    return each.unionByName(summary)


#: Holds a record's digest while it is written or read.
DIGEST = "_tm_digest"


def _digested(df: DataFrame) -> DataFrame:
    """df with each record's digest, worked out once for all sums."""
    return df.withColumn(DIGEST, row_fingerprint(df))


def _lanes() -> dict:
    """Count and set fingerprint of what _digested gives, as sums that a write can observe."""
    h = F.col(DIGEST)
    return {"n": F.count(F.lit(1)), **{f"lane{i}": F.sum(F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)")).cast("decimal(38,0)") for i in range(LANES)}}


def _fingerprint(seen: dict) -> str:
    total = sum(int(seen[f"lane{i}"] or 0) << 32 * (LANES - 1 - i) for i in range(LANES)) % (1 << 256)
    return hashlib.sha256(f"{FORMAT}\x1f{seen['n']}\x1f{total:064x}".encode()).hexdigest()


def _sealed(manifest: dict) -> str:
    return hashlib.sha256(json.dumps(manifest, sort_keys=True).encode()).hexdigest()


def _files(spark: SparkSession, at: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def save(found: DataFrame, root: str, run_id: str) -> dict:
    """Write a run's evidence and return its manifest. A run that is there already is an error."""
    from pyspark.sql import Observation

    spark, kept, seen = found.sparkSession, records(found, run_id), Observation()
    # a null is written as such, so that what is read has the fields that were written
    _digested(kept).observe(seen, *[c.alias(n) for n, c in _lanes().items()]).drop(DIGEST).write.mode("errorifexists").option("ignoreNullFields", False).json(f"{root}/{run_id}/records")
    manifest = {"format": FORMAT, "run_id": run_id, "n_records": seen.get["n"], "fingerprint": _fingerprint(seen.get)}
    manifest["seal"] = _sealed(manifest)
    part, fs = _files(spark, f"{root}/{run_id}/manifest.partial")
    out = fs.create(part, False)
    out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
    out.close()
    if not fs.rename(part, spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{run_id}/manifest.json")):
        raise OSError(f"{run_id}: the manifest could not be put in place")
    return manifest


def manifest_of(spark: SparkSession, root: str, run_id: str) -> dict:
    """A run's manifest; one that is missing or was changed is an error."""
    path, fs = _files(spark, f"{root}/{run_id}/manifest.json")
    if not fs.exists(path):
        raise ValueError(f"{run_id}: the evidence is incomplete")
    manifest = json.loads(spark.read.text(f"{root}/{run_id}/manifest.json", wholetext=True).first()["value"])
    seal = manifest.pop("seal", None)
    if manifest.get("format") != FORMAT or manifest.get("run_id") != run_id or seal != _sealed(manifest):
        raise ValueError(f"{run_id}: the manifest is not the one that was written")
    return manifest


def load(spark: SparkSession, root: str, run_id: str) -> DataFrame:
    """A run's records, after their number and fingerprint were found to be the manifest's. A line that is no record is an error.

    The records are read once and kept in the shared folder, so that what is returned is what was looked at.
    """
    manifest = manifest_of(spark, root, run_id)
    kept, seen = observed(_digested(strict_json.typed_records(spark, f"{root}/{run_id}/records", T.StructType.fromDDL(RECORD), lines=True)), _lanes())
    if seen["n"] != manifest["n_records"] or _fingerprint(seen) != manifest["fingerprint"]:
        raise ValueError(f"{run_id}: the records are not those that were written")
    return kept.drop(DIGEST)

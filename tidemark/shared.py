"""Tables that a job writes for itself, in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder's path below spark.checkpoint.dir; only where that is unset and all runs on this machine, below a temporary folder."""
    if spark.sparkContext.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidemark-"))
    return f"{spark.sparkContext.getCheckpointDir()}/tables-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df, written once to the shared folder and read from there, so that nothing before it runs again."""
    at = shared_folder(df.sparkSession)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def observed(df: DataFrame, measures: dict[str, Column], then: str | None = None) -> tuple[DataFrame, dict[str, object]]:
    """(df as written, measures of all its rows), in one pass. then: of the rows, only those of this condition are written."""
    seen = Observation()
    watched = df.observe(seen, *[c.alias(n) for n, c in measures.items()])
    kept = written(watched.where(then) if then else watched)
    return kept, seen.get


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder that a job has made for itself."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)

"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runs of ASCII white space; words are what lies between them.
SPACE = r"[\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+` of a text as an array; null gives an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder that the cluster names in spark.checkpoint.dir; only where none is named and all runs on this machine, a temporary one."""
    if spark.sparkContext.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidemark-"))


#: With it, Spark deletes the shuffle files of a frame when its execution has ended; without, when the driver's garbage collector comes by.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, tidy: bool = False) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from the files, so that nothing before it is run again. tidy: the shuffle files that this took are deleted at once."""
    checkpoint_dir(df.sparkSession)
    if not tidy:
        return df.checkpoint(eager=True)
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # a frame keeps the setting under which it was made
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts on end, offsets of each text); null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type)
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


def shared_folder(spark: SparkSession) -> str:
    """A new folder's path below the shared checkpoint folder, for tables that a job writes and reads again."""
    checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/tables-{uuid.uuid4().hex}"


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder that a job has made for itself below the shared checkpoint folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)

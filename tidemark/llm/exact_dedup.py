"""Exact deduplication as a stateful stream (DataFrame and Structured Streaming operations only).

Texts stream by in micro-batches. The state, in RocksDB on the executors' disks
and in the checkpoint folder, is keyed by a text's digest and never expires; an
entry holds the identifier of the row that stays so far, that row's locator
(file and row in it) and the number of rows. Copies are counted in each task
before they are sent, so a text of any number of copies is one entry a task.
More files may come later: the same state folder goes on where it stopped.

A digest alone decides nothing: wherever it was hit, the full texts behind it
are compared, and texts that only share a digest are taken apart again.

Defined results: a null text counts as empty, and empty texts equal each other;
a null id is smaller than any other; of rows of one text and id, the last by
file and row stays; extra columns are not looked at (``keep_one`` keeps them);
an empty table gives an empty result; the length of a text doesn't matter.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import cut, remove, shared_folder

#: What a micro-batch reads at most, in bytes of files.
BATCH_BYTES = 256 << 30
#: Repeated digests that are broadcast at most (some 200 bytes each); the others meet their rows by a shuffle.
BROADCAST_ROWS = 100_000
# Settings of the state store while a stream is started.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else each of many small stores reserves megabytes of disk
}


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _glob(path: str) -> str:
    """The path as a pattern that matches it alone: a file source doesn't stream from the bare path of one file."""
    return path if any(c in path for c in "*?[{") else f"{path[:-1]}[{path[-1]}]"


def _located(docs: DataFrame, id: str, text: str, digest: Callable[[Column], Column]) -> DataFrame:
    """digest, text and who: the row's id, file and row in the file (one spelling for local files, which Spark names in two ways)."""
    whole = F.coalesce(F.col(text), F.lit(""))
    who = F.struct(F.col(id).alias("id"), F.regexp_replace("_metadata.file_path", "^file:/+", "file:/").alias("file"), F.col("_metadata.row_index").alias("row"))
    return docs.select(digest(whole).alias("digest"), whole.alias("text"), who.alias("who"))


def observe(spark: SparkSession, path: str, schema: T.StructType, state: str, id: str = "doc_id", text: str = "text", digest: Callable[[Column], Column] = sha256, batch_bytes: int = BATCH_BYTES) -> None:
    """Take all files below path that the state hasn't seen into it. Ends when they are in; after a failure, another call goes on."""
    files = spark.readStream.schema(schema).option("maxBytesPerTrigger", str(batch_bytes)).parquet(_glob(path))
    entries = _located(files, id, text, digest).groupBy("digest").agg(F.max("who").alias("keep"), F.count(F.lit(1)).alias("n"))
    before = {k: spark.conf.get(k, None) for k in STATE_STORE}
    try:
        for k, v in STATE_STORE.items():
            spark.conf.set(k, v)
        stream = entries.writeStream.format("noop").outputMode("update").option("checkpointLocation", state).trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    stream.awaitTermination()


def retained(spark: SparkSession, state: str) -> DataFrame:
    """The state's entries: digest, keep (id, file, row of the row that stays), n."""
    return spark.read.format("statestore").load(state).select("key.digest", F.col("value.max").alias("keep"), F.col("value.count").alias("n"))


def _meet(rows: DataFrame, repeated: DataFrame, n_repeated: int, n_rows: int, how: str, limit: int) -> DataFrame:
    """rows joined with the repeated digests; those that are broadcast are limit at most, whatever the size of the corpus, and a digest of the others has less than a share of 1 / limit of the rows."""
    if n_repeated <= limit:
        return rows.join(F.broadcast(repeated), "digest", how)
    bar = n_rows / limit
    common, others = repeated.where(F.col("n") > bar), repeated.where(F.col("n") <= bar)
    rest = rows.join(F.broadcast(common.select("digest")), "digest", "left_anti").join(others, "digest", how)
    return rows.join(F.broadcast(common), "digest").unionByName(rest)


def decisions(spark: SparkSession, path: str, state: str | None = None, id: str = "doc_id", text: str = "text", digest: Callable[[Column], Column] = sha256, batch_bytes: int = BATCH_BYTES, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A row for each row of the Parquet files at path: doc_id, keep_id, group_size, kept, digest, file, row.

    state: the folder that the stream's state stays in; without one it is made for this call and removed.
    """
    docs = spark.read.parquet(path)
    folder = state or shared_folder(spark)
    observe(spark, path, docs.schema, folder, id, text, digest, batch_bytes)
    known = retained(spark, folder)
    n_rows = known.agg(F.sum("n")).first()[0] or 0
    repeated = cut(known.where("n > 1"))
    if not state:
        remove(spark, folder)
    n_repeated = repeated.count()
    rows = _located(docs, id, text, digest)

    # full texts are compared wherever a digest was hit; each goes once from each task
    hits = _meet(rows, repeated.select("digest", "n"), n_repeated, n_rows, "inner", limit)
    unlike = cut(hits.groupBy("digest", "text").agg(F.count(F.lit(1)).alias("n")).groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("digest"))

    found = _meet(rows.drop("text"), repeated, n_repeated, n_rows, "left", limit).select("digest", "who", F.coalesce("keep", "who").alias("keep"), F.coalesce("n", F.lit(1)).alias("n"))
    if not unlike.isEmpty():  # texts that share a digest: full texts are the keys
        again = rows.join(unlike, "digest", "left_semi")
        whole = again.groupBy("digest", "text").agg(F.max("who").alias("keep"), F.count(F.lit(1)).alias("n"))
        found = found.join(unlike, "digest", "left_anti").unionByName(again.join(whole, ["digest", "text"]).select("digest", "who", "keep", "n"))
    return found.select(F.col("who.id").alias("doc_id"), F.col("keep.id").alias("keep_id"), F.col("n").cast("long").alias("group_size"), F.col("who").eqNullSafe(F.col("keep")).alias("kept"), "digest", "who.file", "who.row")


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs without those whose text another row of a larger id has. docs is written once, to be read by locator."""
    spark, at = docs.sparkSession, shared_folder(docs.sparkSession)
    docs.write.parquet(at)
    stay = decisions(spark, at, id=id, text=text).where("kept").select(F.col("file").alias("_tm_file"), F.col("row").alias("_tm_at"))
    rows = spark.read.parquet(at).select("*", F.regexp_replace("_metadata.file_path", "^file:/+", "file:/").alias("_tm_file"), F.col("_metadata.row_index").alias("_tm_at"))
    return rows.join(stay, ["_tm_file", "_tm_at"], "left_semi").drop("_tm_file", "_tm_at")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: every document with its group of equal texts."""
    return decisions(spark, f"{sf_dir}/documents.parquet").select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM d
"""

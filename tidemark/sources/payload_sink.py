"""Payload files as a target: each row's content becomes a file of its own.

Tasks write below a folder of the attempt, each below one of its own, and leave
path, length and digest of what they have read back in a table that Spark
commits; so files of failed tasks are not in it. When no path occurs twice and
none is taken, tasks move the files to the run's folder, and the run's list
comes last. Where any of it fails, what was moved and the attempt's folder are
deleted. The driver holds no list of files at any time. Files that are there
already are an error, so a run is written once.

A null content is listed with null length and digest and has no file; an empty
content is an empty file.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "relative_path string, content binary"
LISTED = "relative_path string, length long, sha256 string"
#: Stands below an attempt's folder while the attempt goes on.
OPEN = "_open"


def _store(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(re.sub("^(file:)?/+", "file:///", path))


def _list(root: str, run_id: str) -> str:
    return f"{root}/{run_id}.files.json"


def _safe(relative: str | None) -> str:
    steps = (relative or "").split("/")
    if not relative or any(s in ("", ".", "..") for s in steps) or steps[0].startswith("_"):
        raise ValueError(f"{relative!r} is no path below the run's folder")
    return relative


def _is_there(store: pyarrow.fs.FileSystem, at: str) -> bool:
    return store.get_file_info(at).type != pyarrow.fs.FileType.NotFound


def _read(store: pyarrow.fs.FileSystem, at: str) -> bytes:
    with store.open_input_stream(at) as f:
        return f.read()


def _folder(store: pyarrow.fs.FileSystem, at: str, made: set[str]) -> None:
    """Make the folder that a file goes to, once a task."""
    if (folder := at.rpartition("/")[0]) not in made:
        store.create_dir(folder, recursive=True)
        made.add(folder)


def _batch(rows: list[tuple], names: str) -> pa.RecordBatch:
    """Rows as a batch; length is a number, all else text."""
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64() if n == "length" else pa.string()) for i, n in enumerate(names.split())], names=names.split())


def _writer(attempt: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = _store(attempt)
        mine, made = uuid.uuid4().hex, set()
        for batch in batches:
            out = []
            for path, value in zip(batch.column("relative_path"), batch.column("content"), strict=True):
                relative, content = _safe(path.as_py()), value.as_py()
                if content is None:
                    out.append((mine, relative, None, None))
                    continue
                target = f"{at}/{mine}/{relative}"
                _folder(store, target, made)
                with store.open_output_stream(target) as f:
                    f.write(content)
                back = _read(store, target)
                if not _is_there(store, f"{at}/{OPEN}"):
                    store.delete_dir(at)
                    raise OSError("the write was given up meanwhile")
                if back != content:
                    raise OSError(f"{relative}: what was read back is not what was written")
                out.append((mine, relative, len(back), hashlib.sha256(back).hexdigest()))
            yield _batch(out, "task relative_path length sha256")

    return write


def _of_each(base: str, attempt: str, what: Callable[[pyarrow.fs.FileSystem, str, str, set[str]], bool]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Paths for which what(store, where the task has left the file, where it belongs, folders made) holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (store, to), at, made = _store(base), _store(attempt)[1], set()
        for batch in batches:
            rows = zip(batch.column("task").to_pylist(), batch.column("relative_path").to_pylist(), strict=True)
            yield _batch([(p,) for t, p in rows if what(store, f"{at}/{t}/{p}", f"{to}/{p}", made)], "relative_path")

    return run


def _move(store: pyarrow.fs.FileSystem, source: str, target: str, made: set[str]) -> bool:
    _folder(store, target, made)
    try:
        store.move(source, target)
    except FileNotFoundError:  # moved by an earlier attempt of this task
        if not _is_there(store, target):
            raise
    return False


def _undo(store: pyarrow.fs.FileSystem, source: str, target: str, made: set[str]) -> bool:
    if not _is_there(store, source) and _is_there(store, target):
        store.delete_file(target)
    return False


def write_payloads(files: DataFrame, root: str, run_id: str) -> None:
    """Write relative_path and content of every row below root/run_id; all of them or none."""
    spark, base, listed = files.sparkSession, f"{root}/{_safe(run_id)}", _list(root, run_id)
    attempt = f"{base}/_attempt-{uuid.uuid4().hex}"
    store, at = _store(attempt)
    if _is_there(store, _store(listed)[1]):
        raise ValueError(f"{listed} is there already")
    store.create_dir(at, recursive=True)
    store.open_output_stream(f"{at}/{OPEN}").close()
    each = lambda df, what: df.mapInArrow(_of_each(base, attempt, what), "relative_path string")
    try:
        rows = files.select("relative_path", F.col("content").cast("binary").alias("content"))
        rows.mapInArrow(_writer(attempt), f"task string, {LISTED}").write.parquet(f"{attempt}/list")
        kept = spark.read.schema(f"task string, {LISTED}").parquet(f"{attempt}/list")
        if twice := kept.groupBy("relative_path").agg(F.count(F.lit(1)).alias("n")).where("n > 1").first():
            raise ValueError(f"{twice['relative_path']} occurs twice")
        if taken := each(kept, lambda store, _, target, __: _is_there(store, target)).first():
            raise ValueError(f"{taken['relative_path']} is there already")
        with_files = kept.where("length IS NOT NULL")
        try:
            each(with_files, _move).write.format("noop").mode("overwrite").save()
            kept.select("relative_path", "length", "sha256").write.json(listed)
        except BaseException:
            each(with_files, _undo).write.format("noop").mode("overwrite").save()
            raise
    finally:
        if _is_there(store, at):
            store.delete_dir(at)


def listed_payloads(spark: SparkSession, root: str, run_id: str) -> DataFrame:
    """What a run has committed: relative_path, length, sha256 (the two null for a null content)."""
    return spark.read.schema(LISTED).json(_list(root, run_id))


def read_payloads(spark: SparkSession, root: str, run_id: str) -> DataFrame:
    """What the files on a run's list hold, empty ones too: relative_path, length, sha256. Tasks read them, by the list; one that is gone is an error."""
    base = f"{root}/{_safe(run_id)}"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = _store(base)
        for batch in batches:
            out = []
            for path, length in zip(batch.column("relative_path").to_pylist(), batch.column("length").to_pylist(), strict=True):
                content = None if length is None else _read(store, f"{at}/{path}")
                out.append((path, None, None) if content is None else (path, len(content), hashlib.sha256(content).hexdigest()))
            yield _batch(out, "relative_path length sha256")

    return listed_payloads(spark, root, run_id).mapInArrow(read, LISTED)


def lost_payloads(spark: SparkSession, root: str, run_id: str) -> DataFrame:
    """Committed files that are gone, changed or not on the list: relative_path, code (missing, content, unlisted). Spark's readers pass over empty files, so none of those is missed."""
    from tidemark.sources.readers import read_files

    there = read_files(spark, f"{root}/{run_id}").where(~F.col("relative_path").startswith("_")).select("relative_path", F.col("sha256").alias("found"))
    both = listed_payloads(spark, root, run_id).where("length > 0").select("relative_path", "sha256").join(there, "relative_path", "full_outer")
    code = F.when(F.col("found").isNull(), "missing").when(F.col("sha256").isNull(), "unlisted").when(F.col("found") != F.col("sha256"), "content")
    return both.select("relative_path", code.alias("code")).where("code IS NOT NULL")

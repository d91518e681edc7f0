"""SimHash near-duplicate documents by tiled exact comparison.

Distinct fingerprints are laid out in tiles. A tile holds fingerprints of
equal population counts (of the whole word, taken in parts: the differences of
the parts' counts add up to at most the Hamming distance), so a pair of tiles
whose counts differ by more than the radius is skipped without losing a link;
the pairs that remain are compared exactly with numpy: exclusive-or and bit
counts. A tile pair hands on a spanning forest of its links, never all pairs,
tiles have a bounded size, and a crowded cell's tiles are met group by group, so
copies and crowded counts split over tasks.

Defined results: a text without words (or null) has fingerprint zero and
links like any other; a null document id stays null and takes its
component's smallest id if there is one; repeated rows stay rows; an empty
table gives an empty result; extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import cut
from tidemark.llm.components import components

RADIUS = 2
SEED = 42
#: Fingerprints in a tile, about.
TILE = 1024
PARTS = 4
#: Tiles of a cell that a task compares others with.
TILES = 8


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash over 3-word shingles of a text, words split at ASCII white space, A-Z lower-cased."""
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(x), SEED) for x in zip(words, words[1:], words[2:])] if len(words) > 2 else [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        block = np.array(hashes[at : at + (1 << 14)], dtype="<u8")
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) and the columns in keep, a row a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py()) for t in batch.column("text")), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", *keep)), pa.array(fps.view(np.int64))], names=["doc_id", *keep, "fp"])

    picked = docs.select("doc_id", *keep, "text")
    return picked.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema if f.name != "text") + ", fp long")


def _tile_links(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between (or, if they are the same, within) two tiles."""
    near = np.bitwise_count(a[:, None] ^ b[None, :]) <= radius
    if len(a) == len(b) and (a == b).all():
        np.fill_diagonal(near, False)
    rows, cols = near.any(axis=1), near.any(axis=0)
    if not rows.any():
        return a[:0], b[:0]
    a, b, near = a[rows], b[cols], near[np.ix_(rows, cols)]
    left = a.view(np.int64).copy()  # labels: the smallest fingerprint seen so far
    right = b.view(np.int64).copy()
    top = np.iinfo(np.int64).max
    while True:
        old = left.copy()
        right = np.minimum(right, np.where(near, left[:, None], top).min(axis=0))
        left = np.minimum(left, np.where(near, right[None, :], top).min(axis=1))
        if (left == old).all():
            break
    return np.concatenate([a.view(np.int64), b.view(np.int64)]), np.concatenate([left, right])


def near_links(fps: DataFrame, radius: int = RADIUS, tile: int = TILE, parts: int = PARTS) -> DataFrame:
    """Links (a, b) that join the same fingerprints as all pairs within the radius do. fps: distinct values in column fp."""
    width = 64 // parts
    masks = [((1 << width) - 1) << (width * i) for i in range(parts)]
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    counts = [F.bit_count(F.col("fp").bitwiseAND(F.lit(m))).cast("int") for m in signed]
    celled = fps.select("fp", F.array(*counts).alias("cell"))
    # a row a cell, of which there are (width + 1) ** parts at most
    crowd = celled.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).select("cell", F.ceil(F.col("n") / tile).cast("int").alias("pieces"), F.ceil(F.col("n") / (tile * TILES)).cast("int").alias("groups"))
    tiles = (
        celled.join(F.broadcast(crowd), "cell").withColumn("piece", F.pmod(F.xxhash64("fp"), F.col("pieces")).cast("int"))
        .groupBy("cell", "piece").agg(F.collect_list("fp").alias("fps"), F.first("groups").alias("groups")).withColumn("group", F.col("piece") % F.col("groups"))
    )
    steps = [s for s in product(range(-radius, radius + 1), repeat=parts) if sum(map(abs, s)) <= radius and s >= (0,) * parts]
    moves = F.explode(F.array(*[F.array(*[F.lit(x) for x in s]) for s in steps]))
    left = tiles.select(F.col("cell").alias("from"), F.col("piece").alias("left_piece"), F.col("fps").alias("left"), moves.alias("move")).withColumn("cell", F.zip_with("from", "move", lambda x, y: x + y))
    # every group of the other cell's tiles is met apart, so a crowded cell spreads over tasks
    left = left.join(F.broadcast(crowd.select("cell", "groups")), "cell").select("cell", "from", "left_piece", "left", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"))
    pairs = left.join(tiles.drop("groups"), ["cell", "group"]).where((F.col("from") < F.col("cell")) | (F.col("left_piece") <= F.col("piece")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in zip(batch.column("left"), batch.column("fps")):
                u, v = _tile_links(np.asarray(x.values).view(np.uint64), np.asarray(y.values).view(np.uint64), radius)
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["a", "b"])

    return pairs.select("left", "fps").mapInArrow(run, "a long, b long").where("a <> b")


def _grouped(docs: DataFrame, radius: int, tile: int, keep: tuple[str, ...]) -> DataFrame:
    """As near_duplicates, and _tm_component: the component's own key, its smallest fingerprint."""
    marked = cut(fingerprints(docs, keep))
    distinct = marked.groupBy("fp").agg(F.min("doc_id").alias("first"))
    joined = components(near_links(distinct.select("fp"), radius, tile)).withColumnRenamed("node", "fp")
    grouped = distinct.join(joined, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = grouped.groupBy("component").agg(F.min("first").alias("component_id"))
    return marked.join(grouped.join(least, "component").select("fp", "component_id", F.col("component").alias("_tm_component")), "fp")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, tile: int = TILE, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id that links reach) and the columns in keep, a row a document."""
    return _grouped(docs, radius, tile, keep).drop("_tm_component")


def keep_first(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The documents without near copies: of each component the row with the smallest id stays (of equal ids, one)."""
    columns = docs.columns
    numbered = cut(docs.withColumn("_tm_row", F.monotonically_increasing_id()))
    marked = _grouped(numbered, radius, TILE, keep=("_tm_row",))
    first = marked.groupBy("_tm_component").agg(F.min(F.struct(F.coalesce(F.col("doc_id") != F.col("component_id"), F.lit(True)), "_tm_row")).alias("first"))
    return numbered.join(first.select(F.col("first._tm_row").alias("_tm_row")), "_tm_row", "left_semi").select(*columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: fingerprint and component of every document."""
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")

"""Suffix-array dedup: bytes covered by a 50-byte string that also starts in a document with a smaller id.

A depth-limited radix sort, most significant digit first. Suffixes are ordered
through SPAN bytes only, so equal groups after the last digit are exactly the
repeated SPAN-byte windows, and a suffix leaves as soon as no other text has
its digits:

1. The first digit of a window is the GRAM bytes at its anchor, a place chosen
   by the window's bytes alone (smallest hash of ORDER bytes, modulo the number
   of places); equal windows have equal digits. Neighbouring windows share an
   anchor, so a run of windows is one entry. Runs whose digit no second text
   has are left out.
2. The second digit of the runs that remain is all the run's bytes. Of equal
   runs all but those of the smallest id are repeated as a whole.
3. The first of each group of equal runs is compared window by window with the
   other runs of its first digit.

Exact copies of a text are settled by their hash beforehand. Entries travel as
packed arrays in buckets of bounded size. What a batch of texts can tell by
itself is settled there and is not sent: of a digit that several texts of a
batch share, two entries are sent, so a passage in a third of all documents
does not fill a bucket.

Defined results: a null text counts as empty; a text shorter than SPAN loses
nothing; of repeated ids none is smaller; a null id is larger than all others;
an empty table gives an empty result; extra columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import cut, text_bytes

SPAN, GRAM, ORDER = 50, 28, 5
PLACES = SPAN - GRAM + 1
ASIDE = SPAN - GRAM
#: Bytes of text whose entries share a bucket, about; buckets at least.
BUCKET_BYTES, BUCKETS = 16 << 20, 64
#: Bytes of text that are worked on at once.
BLOCK = 3 << 20
LAST = (1 << 63) - 1

_RANDOM = np.random.default_rng(5)
_LETTER = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64)
_STEP = _RANDOM.integers(1, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_RUN = np.dtype([("key", "<u8"), ("text", "<u4"), ("low", "<u4"), ("left", "u1"), ("right", "u1"), ("aside", "u1", 2 * ASIDE)])
_SPANS = np.dtype([("begin", "<i8"), ("end", "<i8")])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _STEP[60]
    x = (x ^ (x >> np.uint64(29))) * _STEP[61]
    return x ^ (x >> np.uint64(32))


def grams(data: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of the n bytes from each place on, from hashes of 1, 2, 4 ... bytes."""
    part, width, out, done = _LETTER[data], 1, None, 0
    while True:
        if n & width:
            out, done = (part, width) if out is None else (out[: len(part) - done] * _STEP[width.bit_length()] + part[done : len(out)][: len(part) - done], done + width)
        if 2 * width > n:
            return _mixed(out[: max(0, len(data) - n + 1)])
        part, width = part[:-width] * _STEP[32 + width.bit_length()] + part[width:], 2 * width


def runs(data: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """The runs of windows with one anchor: text, low and high (first and last window), anchor, key (hash of the anchor's bytes)."""
    n = len(data) - SPAN + 1
    if n <= 0:
        return {k: np.zeros(0, np.uint64 if k == "key" else np.int64) for k in ("text", "low", "high", "anchor", "key")}
    bits = np.uint64(max(24, int(len(data)).bit_length()))
    least = (grams(data, ORDER) >> bits << bits) | np.arange(len(data) - ORDER + 1, dtype=np.uint64)
    width, want = 1, SPAN - ORDER + 1
    while 2 * width <= want:
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    least = np.minimum(least[: len(least) - (want - width)], least[want - width :])
    place = np.arange(n)
    anchor = place + ((least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64) - place) % PLACES
    whole = np.ones(n + 1, bool)  # windows that lie in one text
    crossing = (at[1:-1, None] - np.arange(1, SPAN)).ravel()
    whole[crossing[(crossing >= 0) & (crossing < n)]] = False
    whole[n] = False
    begins = np.flatnonzero(whole[:-1] & ~(np.append(False, whole[:-2]) & (anchor == np.append(-1, anchor[:-1]))))
    ends = np.flatnonzero(whole[:-1] & ~(whole[1:] & (anchor == np.append(anchor[1:], -1))))
    return {"text": np.searchsorted(at, begins, "right") - 1, "low": begins, "high": ends, "anchor": anchor[begins], "key": grams(data, GRAM)[anchor[begins]]}


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(rows of the batch, bytes, offsets) of blocks of texts."""
    for batch in batches:
        data, at = text_bytes(batch.column("text"))
        i = 0
        while i < batch.num_rows:
            j = min(batch.num_rows, max(i + 1, int(np.searchsorted(at, at[i] + BLOCK, "right")) - 1))
            yield batch.slice(i, j - i), data[at[i] : at[j]], at[i : j + 1] - at[i]
            i = j


def _packed(bucket: np.ndarray, entries: np.ndarray, ids: np.ndarray, hashes: np.ndarray, kind: int) -> Iterator[tuple]:
    """(bucket, kind, ids of the texts, hashes of the texts, entries) for each bucket; an entry's text counts within the row."""
    order = np.argsort(bucket, kind="stable")
    bucket, entries = bucket[order], entries[order]
    for part in np.split(np.arange(len(bucket)), np.flatnonzero(np.diff(bucket)) + 1) if len(bucket) else []:
        chosen = entries[part]
        used, local = np.unique(chosen["text"], return_inverse=True)
        chosen["text"] = local
        yield int(bucket[part[0]]), kind, ids[used].tobytes(), hashes[used].tobytes(), (_shortened(chosen) if chosen.dtype == _FIRST else chosen).tobytes()


_PACKET = "bucket int, kind int, ids binary, hashes binary, entries binary"
_PACKET_NAMES = ["bucket", "kind", "ids", "hashes", "entries"]
_PACKET_TYPES = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]


def _packets(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(list(zip(*rows)) or [()] * 5, _PACKET_TYPES)], names=_PACKET_NAMES)


_FIRST = np.dtype([("key", "<u8"), ("text", "<u4"), ("no", "<u4"), ("sure", "u1")])
#: The same on its way: of the key what the bucket does not say, no and sure together. Equal short keys of unlike digits
#: only let a run through to the second digit. A block holds fewer than 65536 texts of SPAN bytes.
_SHORT = np.dtype([("key", "<u4"), ("text", "<u2"), ("no", "<u4")])


def _shortened(entries: np.ndarray) -> np.ndarray:
    out = np.zeros(len(entries), _SHORT)
    out["key"], out["text"], out["no"] = entries["key"] >> np.uint64(32), entries["text"], entries["no"] << np.uint32(2) | entries["sure"]
    return out


def _lengthened(packed: bytes) -> np.ndarray:
    short = np.frombuffer(packed, _SHORT)
    out = np.zeros(len(short), _FIRST)
    out["key"], out["text"], out["no"], out["sure"] = short["key"], short["text"], short["no"] >> np.uint32(2), short["no"] & np.uint32(3)
    return out


def _unpacked(table: pa.Table, kind: int, dtype: np.dtype) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entries, ids, hashes) of all packets of a kind; an entry's text counts within the result."""
    entries, ids, hashes, n = [np.zeros(0, dtype)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    for k, i, h, e in zip(*(table.column(c).to_pylist() for c in _PACKET_NAMES[1:])):
        if k == kind:
            entries.append(_lengthened(e) if dtype == _FIRST else np.frombuffer(e, dtype).copy())
            entries[-1]["text"] += n
            ids.append(np.frombuffer(i, np.int64))
            hashes.append(np.frombuffer(h, np.int64))
            n += len(ids[-1])
    return np.concatenate(entries), np.concatenate(ids), np.concatenate(hashes)


def _several(key: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order by key and other, group of each in that order, whether each group has more than one value of other)."""
    order = np.lexsort((other, key))
    k, o = key[order], other[order]
    new = np.append(True, k[1:] != k[:-1]) if len(k) else np.zeros(0, bool)
    group, begin = np.cumsum(new) - 1, np.flatnonzero(new)
    last = np.append(begin[1:], len(k)) - 1
    return order, group, o[begin] != o[last] if len(k) else np.zeros(0, bool)


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return np.asarray(batch.column("id")), np.asarray(batch.column("hash"))


def _first_digits(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, at in _blocks(batches):
            ids, hashes = _columns(batch)
            found = runs(data, at)
            entries = np.zeros(len(found["key"]), _FIRST)
            entries["key"], entries["text"] = found["key"], found["text"]
            entries["no"] = np.arange(len(entries)) - np.searchsorted(found["text"], found["text"])
            order, group, several = _several(entries["key"], hashes[entries["text"]])
            entries = entries[order]
            sure = several[group] if len(group) else np.zeros(0, bool)
            edge = np.append(True, group[1:] != group[:-1]) | np.append(group[1:] != group[:-1], True) if len(group) else sure
            marks = entries[sure & edge].copy()  # tell the other batches that the digit is shared
            entries["sure"] = sure
            scattered = _mixed(entries["key"] + entries["no"].astype(np.uint64) * _STEP[3] + hashes.view(np.uint64)[entries["text"]])
            bucket = (np.concatenate([np.where(sure, scattered, entries["key"]), marks["key"]]) % np.uint64(buckets)).astype(np.int64)
            marks["sure"] = 2
            yield _packets(list(_packed(bucket, np.concatenate([entries, marks]), ids, hashes, 0)))

    return run


_NUMBERS = "id long, hash long, numbers binary"


def _shared(table: pa.Table) -> pa.Table:
    """The numbers of the runs whose first digit a second text has, a row a text."""
    entries, ids, hashes = _unpacked(table, 0, _FIRST)
    sure, rest = entries[entries["sure"] == 1], entries[entries["sure"] != 1]
    order, group, several = _several(rest["key"], hashes[rest["text"]])
    rest = rest[order]
    rest = rest[several[group] & (rest["sure"] == 0)] if len(rest) else rest
    return _by_text(np.concatenate([sure, rest]), ids, hashes, lambda x: np.unique(x["no"]).astype("<u4").tobytes(), "numbers")


def _by_text(entries: np.ndarray, ids: np.ndarray, hashes: np.ndarray, pack, name: str) -> pa.Table:
    order = np.lexsort((hashes[entries["text"]], ids[entries["text"]]))
    entries = entries[order]
    i, h = ids[entries["text"]], hashes[entries["text"]]
    cuts = np.flatnonzero((i[1:] != i[:-1]) | (h[1:] != h[:-1])) + 1
    begin = np.append(0, cuts) if len(i) else cuts
    values = [pack(entries[a:b]) for a, b in zip(begin, np.append(begin[1:], len(i)))] if len(i) else []
    return pa.table([pa.array(i[begin]), pa.array(h[begin]), pa.array(values, pa.binary())], names=["id", "hash", name])


def _whole(entries: np.ndarray) -> np.ndarray:
    """A hash of each run's bytes and its shape."""
    out = entries["key"] + entries["left"].astype(np.uint64) * _STEP[1] + entries["right"].astype(np.uint64) * _STEP[2]
    for i in range(2 * ASIDE):
        out = out * _STEP[7] + _LETTER[entries["aside"][:, i]]
    return _mixed(out)


def _spread(entries: np.ndarray) -> np.ndarray:
    """The bytes that a run's windows cover, as spans that carry the run's text."""
    out = np.zeros(len(entries), [("text", "<u4"), *_SPANS.descr])
    out["text"], out["begin"] = entries["text"], entries["low"]
    out["end"] = entries["low"].astype(np.int64) + entries["left"] + GRAM + entries["right"]
    return out


def _second_digits(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, at in _blocks(batches):
            ids, hashes = _columns(batch)
            found = runs(data, at)
            first = np.searchsorted(found["text"], np.arange(len(at)))
            chosen = [first[t] + np.frombuffer(b.as_py(), "<u4").astype(np.int64) for t, parts in enumerate(batch.column("parts")) for b in parts]
            chosen = np.unique(np.concatenate(chosen)) if chosen else np.zeros(0, np.int64)
            text, low, high, anchor = (found[k][chosen] for k in ("text", "low", "high", "anchor"))
            entries = np.zeros(len(chosen), _RUN)
            entries["key"], entries["text"], entries["low"] = found["key"][chosen], text, low - at[text]
            entries["left"], entries["right"] = anchor - low, high + SPAN - GRAM - anchor
            step = np.arange(ASIDE)
            padded = np.append(data, np.uint8(0))
            left = np.where(step < (anchor - low)[:, None], (anchor - 1)[:, None] - step, len(data))  # from the anchor outwards
            right = np.where(step < entries["right"][:, None], (anchor + GRAM)[:, None] + step, len(data))
            entries["aside"] = padded[np.concatenate([left, right], axis=1)]
            whole, own = _whole(entries), ids[entries["text"]]
            order = np.lexsort((own, whole))
            same = np.append(False, whole[order][1:] == whole[order][:-1])
            least = np.flatnonzero(~same)
            smallest = own[order][least[np.cumsum(~same) - 1]] if len(order) else own
            later = own[order] > smallest
            entries = entries[order]
            spans = _spread(entries[later])
            kept = entries[~later]
            rows = list(_packed((kept["key"] % np.uint64(buckets)).astype(np.int64), kept, ids, hashes, 1))
            rows += _packed((_mixed(ids.view(np.uint64)[spans["text"]]) % np.uint64(buckets)).astype(np.int64), spans, ids, hashes, 2)
            yield _packets(rows)

    return run


def _repeated(table: pa.Table) -> pa.Table:
    """The repeated bytes that a bucket knows of, as spans, a row a text."""
    entries, ids, hashes = _unpacked(table, 1, _RUN)
    known, more_ids, more_hashes = _unpacked(table, 2, np.dtype([("text", "<u4"), *_SPANS.descr]))
    known["text"] += len(ids)
    own, whole = ids[entries["text"]], _whole(entries)
    order = np.lexsort((own, whole, entries["key"]))
    entries, own, whole = entries[order], own[order], whole[order]
    new_key = np.append(True, entries["key"][1:] != entries["key"][:-1])[: len(entries)]
    new_run = np.append(True, whole[1:] != whole[:-1])[: len(entries)] | new_key
    smallest = own[np.flatnonzero(new_run)][np.cumsum(new_run) - 1] if len(own) else own
    later = own > smallest
    kinds = np.add.reduceat(new_run, np.flatnonzero(new_key))[np.cumsum(new_key) - 1] if len(own) else own
    open_ = entries[~later & (kinds > 1)]
    out = np.concatenate([known, _spread(entries[later]), _windows(open_, ids)])
    return _by_text(out, np.concatenate([ids, more_ids]), np.concatenate([hashes, more_hashes]), lambda x: _merged(x).tobytes(), "spans")


def _windows(entries: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Spans of the single windows that a run of a smaller id has too."""
    none = np.zeros(0, [("text", "<u4"), *_SPANS.descr])
    if not len(entries):
        return none
    left, right = (np.zeros((len(entries), ASIDE + 1), np.uint64) for _ in range(2))
    for i in range(ASIDE):
        left[:, i + 1] = left[:, i] * _STEP[8] + _LETTER[entries["aside"][:, i]]
        right[:, i + 1] = right[:, i] * _STEP[9] + _LETTER[entries["aside"][:, ASIDE + i]]
    j = np.arange(ASIDE + 1)  # bytes of the window before the anchor
    row, before = np.nonzero((j <= entries["left"][:, None]) & (ASIDE - j <= entries["right"][:, None]))
    window = _mixed(entries["key"][row] + left[row, before] * _STEP[10] + right[row, ASIDE - before] * _STEP[11] + before.astype(np.uint64) * _STEP[12])
    own = ids[entries["text"][row]]
    order = np.lexsort((own, window))
    new = np.append(True, window[order][1:] != window[order][:-1])
    later = own[order] > own[order][np.flatnonzero(new)][np.cumsum(new) - 1]
    row, before = row[order][later], before[order][later]
    out = np.zeros(len(row), none.dtype)
    out["text"], out["begin"] = entries["text"][row], entries["low"][row].astype(np.int64) + entries["left"][row] - before
    out["end"] = out["begin"] + SPAN
    return out


def _merged(spans: np.ndarray) -> np.ndarray:
    """The union of spans as spans that neither touch nor overlap, in order."""
    order = np.argsort(spans["begin"], kind="stable")
    begin, end = spans["begin"][order], np.maximum.accumulate(spans["end"][order])
    new = np.append(True, begin[1:] > end[:-1])[: len(begin)]
    out = np.zeros(int(new.sum()), _SPANS)
    out["begin"], out["end"] = begin[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)] if len(end) else end
    return out


def _remaining(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, copy, parts in zip(batch.column("text"), batch.column("copy"), batch.column("parts")):
            data = (text.as_py() or "").encode()
            if copy.as_py() and len(data) >= SPAN:
                spans = np.array([(0, len(data))], _SPANS)
            else:
                parts = [np.frombuffer(b, _SPANS) for b in parts.as_py() or []]
                spans = _merged(np.concatenate(parts)) if parts else np.zeros(0, _SPANS)
            edges = [0, *(int(x) for s in spans for x in s), len(data)]
            left = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
            rows.append((len(data), len(data) - len(left), len(spans), hashlib.sha256(left).hexdigest(), left))
        columns = list(zip(*rows)) or [()] * 5
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(list(c), t) for c, t in zip(columns, types))], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def repeated_bytes(docs: DataFrame) -> DataFrame:
    """A row a document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes that remain)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("id"), F.xxhash64(text).alias("hash"), text.alias("text"))
    sizes = cut(keyed.select("id", "hash", F.octet_length("text").cast("long").alias("size")))
    firsts = sizes.groupBy("hash", "size").agg(F.min("id").alias("id"))
    total = sizes.agg(F.sum("size")).first()[0] or 0
    buckets = max(BUCKETS, total // BUCKET_BYTES)
    texts = keyed.join(firsts.where(F.col("size") >= SPAN).select("id", "hash").hint("shuffle_hash"), ["id", "hash"], "left_semi")
    shared = texts.mapInArrow(_first_digits(buckets), _PACKET).groupBy("bucket").applyInArrow(_shared, _NUMBERS)
    numbers = shared.groupBy("id", "hash").agg(F.collect_list("numbers").alias("parts"))
    spans = texts.join(numbers.hint("shuffle_hash"), ["id", "hash"]).mapInArrow(_second_digits(buckets), _PACKET).groupBy("bucket").applyInArrow(_repeated, "id long, hash long, spans binary")
    parts = spans.groupBy("id", "hash").agg(F.collect_list("spans").alias("parts"))
    found = firsts.select("id", "hash", F.lit(False).alias("copy"))
    out = keyed.join(found.join(parts, ["id", "hash"], "left").hint("shuffle_hash"), ["id", "hash"], "left").withColumn("copy", F.coalesce("copy", F.lit(True)))
    left = out.select("id", "text", "copy", "parts").mapInArrow(_remaining, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return left.select(F.nullif("id", F.lit(LAST)).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: what is left of every document."""
    return repeated_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")

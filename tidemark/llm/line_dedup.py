"""Fuzzy line dedup by MinHash over character shingles.

Every distinct line gets a one-permutation MinHash signature (its shingles'
hashes fall into SLOTS slots, the least of each counts, empty slots borrow
from others), cut into BANDS bands. Lines that share a band are candidates,
and every candidate pair is verified by the Jaccard similarity of the whole
shingle sets:

* a band of at most GROUP lines is one group, and so is each piece of a larger
  band, together with the band's smallest line; all pairs of a group are
  verified at once, equal groups of several bands only once;
* of the larger bands, the lines that still lie in different components are
  then compared in blocks of bounded size, so no candidate link is lost, and
  copies that are linked already are not compared again. Bands with the same
  largest component are one family there and are compared once.

Linked lines are joined by distributed union-find. Of each component, and of
exact repeats, the first line in the order of (document id, line number) stays.

Signatures travel packed, in buckets of bounded size; a band that many lines of
one block share sends one of them to its bucket. What a step has shuffled is
deleted when the step's result is written.

With six values a band and 20 bands a pair of similarity 0.8 is found with
probability 0.998, one of 0.9 with 0.9999999.

Defined results: a null text has no lines; lines without a word are layout and
always stay; lines are compared without white space at their ends, shingles
with A-Z lower-cased; a line shorter than a shingle is one shingle; rows of the
same id and text count as one document and get the same result; a null id comes
first; an empty table gives an empty result; extra columns stay as they are.
Lines are known by a 64-bit hash; shingles are compared by 45 bits of one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import cut, text_bytes
from tidemark.llm.components import components

SHINGLE, BANDS, ROWS = 6, 20, 6
SLOTS = BANDS * ROWS
THRESHOLD = 0.8
#: Bytes of text whose signatures share a bucket, about; buckets at least; bytes of text that are worked on at once.
BUCKET_BYTES, BUCKETS, BLOCK = 12 << 20, 48, 2 << 20
#: Lines that are verified all with all; lines of a block that may share a band before only one is sent on; lines of a block of a larger band.
GROUP, SENT, BLOCK_LINES = 32, 8, 256
#: Characters whose shingles are worked on at once: few enough for the processor's cache in signatures.
CHUNK, GROUP_CHARS = 1 << 16, 1 << 18
#: Characters of a group beyond which its lines are compared pair by pair.
LONG = 4 << 20
#: White space other than the line end.
EDGE = " \t\r\x0b\x0c"

_RANDOM = np.random.default_rng(9)
_ODD = _RANDOM.integers(1, 1 << 62, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHORT = _ODD.astype(np.uint32)
_NONE = np.uint32(0xFFFFFFFF)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _ODD[8]
    return x ^ (x >> np.uint64(29))


def _scrambled(x: np.ndarray) -> np.ndarray:
    """32 bits mixed in place."""
    for shift, k in ((16, 9), (15, 10), (16, 0)):
        x ^= x >> np.uint32(shift)
        if k:
            x *= _SHORT[k]
    return x


def _lowered(points: np.ndarray) -> np.ndarray:
    return points + ((points - np.uint32(65) < np.uint32(26)).astype(np.uint32) << np.uint32(5))


def _decoded(data: np.ndarray) -> np.ndarray:
    return np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)


def _cuts(size: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of items of about so much size together, or of one."""
    total, i = np.append(0, np.cumsum(size)), 0
    while i < len(size):
        j = max(i + 1, int(np.searchsorted(total, total[i] + most, "right")) - 1)
        yield i, j
        i = j


def _places(begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(each place of ranges, its range)."""
    of = np.repeat(np.arange(len(size), dtype=np.int32), size)
    return np.arange(len(of)) + np.repeat(begin - (np.cumsum(size) - size), size), of


def signatures(points: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """One row of SLOTS least hashes a line; points: code points, begin and end: of each line."""
    out = np.full(len(begin) * SLOTS, _NONE, np.uint32)
    size = np.maximum(end - begin - SHINGLE + 1, 0)
    for i, j in _cuts(size, CHUNK):
        some = i + np.flatnonzero(size[i:j])
        if len(some):
            start = int(begin[some[0]])
            lower = _lowered(points[start : int(end[some[-1]])])
            n = len(lower) - SHINGLE + 1
            rolled = lower[:n].copy()
            for k in range(1, SHINGLE):
                rolled *= _SHORT[11]
                rolled += lower[k : n + k]
            place, of = _places(begin[some] - start, size[some])
            value = _scrambled(rolled[place])
            slot = (value >> np.uint32(16)) * np.uint32(SLOTS) >> np.uint32(16)
            value *= _SHORT[12]
            value ^= value >> np.uint32(15)
            value &= np.uint32(0xFFFFFFFE)
            np.minimum.at(out, some[of] * SLOTS + slot, value)
    out = out.reshape(-1, SLOTS)
    for i in np.flatnonzero(size == 0):  # a short line is one shingle
        out[i, 0] = xxhash.xxh32_intdigest(_lowered(points[begin[i] : end[i]]).tobytes()) & 0xFFFFFFFE
    row, column = np.nonzero(out == _NONE)
    full, round_ = out != _NONE, 0
    while len(row):  # each empty slot asks others in an order of its own
        round_ += 1
        asked = (_mixed(column.astype(np.uint64) * _ODD[3] + np.uint64(round_ * int(_ODD[5]) % (1 << 64))) % np.uint64(SLOTS)).astype(np.int64)
        found = full[row, asked]
        out[row[found], column[found]] = out[row[found], asked[found]]
        row, column = row[~found], column[~found]
        if round_ > 20 * SLOTS:  # what no order reaches takes the first there is
            out[row, column] = out[row, full[row].argmax(axis=1)]
            break
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """(lines, BANDS) hashes of each line's bands."""
    keys = np.zeros((len(signature), BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64) * _ODD[1]
    for i in range(ROWS):
        keys = _mixed(keys * _ODD[2] + signature[:, i::ROWS])
    return keys


def _lines(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(code points, begin and end of each distinct line with a word, its id)."""
    raw = data.tobytes()
    offset = np.append(0, np.cumsum((data & 0xC0) != 0x80))  # of code points
    begin, end, ids, seen = [], [], [], set()
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        for line in raw[a:b].split(b"\n"):
            kept = line.strip()
            if kept:
                no = xxhash.xxh64_intdigest(kept, 42)
                if no not in seen:
                    seen.add(no)
                    start = a + len(line) - len(line.lstrip())
                    begin.append(start)
                    end.append(start + len(kept))
                    ids.append(no)
            a += len(line) + 1
    points = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
    return points, offset[np.array(begin, np.int64)], offset[np.array(end, np.int64)], np.array(ids, np.uint64).view(np.int64)


#: A band's key in its bucket, and a line; crowded: the block holds more of its lines, which have gone as pieces.
_ENTRY = np.dtype([("key", "<u4"), ("line", "<i8")])
ONE, CROWDED, PIECES = 0, 1, 2
_PACKET = "bucket int, kind int, entries binary"
_FOUND = "band long, ids array<long>, crowded boolean"


def _groups(order: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(begin, size) of the runs of equal keys[order]."""
    k = keys[order]
    begin = np.flatnonzero(np.append(True, k[1:] != k[:-1])[: len(k)])
    return begin, np.diff(np.append(begin, len(k)))


def _pieces(band: int, ids: np.ndarray) -> list[np.ndarray]:
    """A large band as pieces of at most GROUP lines that all hold its smallest line, each after the band."""
    rest = ids[ids != ids.min()]
    return [np.concatenate([[band, ids.min()], rest[i : i + GROUP - 1]]) for i in range(0, len(rest), GROUP - 1)]


def _banded(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = text_bytes(batch.column("text"))
            for i, j in _cuts(np.diff(at), BLOCK):
                points, begin, end, ids = _lines(data[at[i] : at[j]], at[i : j + 1] - at[i])
                keys, lines = band_keys(signatures(points, begin, end)).ravel(), np.repeat(ids, BANDS)
                order = np.argsort(keys)
                first, size = _groups(order, keys)
                entries = np.zeros(len(keys), _ENTRY)
                entries["key"], entries["line"] = keys[order].astype(np.uint32), lines[order]
                bucket = ((keys[order] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
                rows, sent, marks, home = [], np.ones(len(keys), bool), [], []
                for a, n in zip(first[size > SENT], size[size > SENT]):
                    part = slice(a, a + n)
                    sent[part] = False
                    marks.append((entries["key"][a], entries["line"][part].min()))
                    home.append(bucket[a])
                    for no, piece in enumerate(_pieces(int(bucket[a]) << 32 | int(entries["key"][a]), entries["line"][part])):
                        rows.append(((int(entries["key"][a]) + no) % buckets, PIECES, piece.astype("<i8").tobytes()))
                for kind, some, to in ((ONE, entries[sent], bucket[sent]), (CROWDED, np.array(marks, _ENTRY), np.array(home, np.int64))):
                    edges = np.searchsorted(to, np.arange(buckets + 1))
                    rows += [(b, kind, some[x:y].tobytes()) for b, (x, y) in enumerate(zip(edges, edges[1:])) if y > x]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(list(zip(*rows)) or [()] * 3, (pa.int32(), pa.int32(), pa.binary()))], names=["bucket", "kind", "entries"])

    return run


def _met(key: tuple, table: pa.Table) -> pa.Table:
    """The bands of a bucket that several lines share: small ones whole, others in pieces."""
    kinds, blobs = table.column("kind").to_pylist(), table.column("entries").to_pylist()
    found = [(p, True) for p in (np.frombuffer(b, "<i8") for k, b in zip(kinds, blobs) if k == PIECES)]
    some = [np.concatenate([np.zeros(0, _ENTRY), *(np.frombuffer(b, _ENTRY) for k, b in zip(kinds, blobs) if k == kind)]) for kind in (ONE, CROWDED)]
    entries, crowded = np.concatenate(some), np.unique(some[1]["key"])
    order = np.lexsort((entries["line"], entries["key"]))
    entries = entries[order]
    entries = entries[np.append(True, (entries["key"][1:] != entries["key"][:-1]) | (entries["line"][1:] != entries["line"][:-1]))[: len(entries)]]
    first, size = _groups(np.arange(len(entries)), entries["key"])
    for a, n in zip(first[size > 1], size[size > 1]):
        band, ids = key[0].as_py() << 32 | int(entries["key"][a]), entries["line"][a : a + n]
        large = n > GROUP or entries["key"][a] in crowded
        found += [(p, True) for p in _pieces(band, ids)] if large else [(np.concatenate([[band], ids]), False)]
    return pa.table([pa.array([int(p[0]) for p, _ in found], pa.int64()), pa.array([p[1:] for p, _ in found], pa.list_(pa.int64())), pa.array([c for _, c in found], pa.bool_())], names=["band", "ids", "crowded"])


def band_groups(docs: DataFrame) -> DataFrame:
    """(band, ids, crowded): the lines of each band that several distinct lines share; a crowded band in pieces that share a line."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return docs.select("text").mapInArrow(_banded(max(BUCKETS, size // BUCKET_BYTES)), _PACKET).groupBy("bucket").applyInArrow(_met, _FOUND)


def shingles(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each shingle of lines, its line)."""
    data, at = text_bytes(column)
    offset = np.append(0, np.cumsum((data & 0xC0) != 0x80))[at]
    lower = _lowered(_decoded(data)).astype(np.uint64)
    n = max(0, len(lower) - SHINGLE + 1)
    rolled = lower[:n].copy()
    for k in range(1, SHINGLE):
        rolled *= _ODD[6]
        rolled += lower[k : n + k]
    size = np.diff(offset)
    place, of = _places(offset[:-1], np.maximum(size - SHINGLE + 1, 0))
    short = np.flatnonzero(size < SHINGLE)
    whole = np.array([xxhash.xxh64_intdigest(lower[offset[i] : offset[i + 1]].tobytes()) for i in short], np.uint64)
    return _mixed(np.concatenate([rolled[place], whole]) * _ODD[7]), np.concatenate([of, short.astype(np.int32)])


def _near_pairs(lines: pa.Array, group: np.ndarray, local: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, i, j): links that join the same lines of a group as all its pairs of the Jaccard similarity do; groups of at most GROUP lines, numbered from 0 in order."""
    values, line = shingles(lines)
    # a key is the group (14 bits), 45 bits of the shingle, the line within its group
    keys = np.sort(group[line].astype(np.uint64) << np.uint64(50) | values >> np.uint64(19) << np.uint64(5) | local[line].astype(np.uint64))
    keys = keys[np.append(True, keys[1:] != keys[:-1])[: len(keys)]]
    of, who = (keys >> np.uint64(50)).astype(np.int64), (keys & np.uint64(31)).astype(np.int64)
    sizes = np.bincount(of * GROUP + who, minlength=(int(group[-1]) + 1) * GROUP).reshape(-1, GROUP)
    shingle = keys >> np.uint64(5)
    first = np.flatnonzero(np.append(True, shingle[1:] != shingle[:-1]))
    # which lines of the group hold a shingle, as bits; how many shingles each set of lines holds
    holders = np.sort(of[first].astype(np.uint64) << np.uint64(32) | np.bitwise_or.reduceat(np.uint64(1) << who.astype(np.uint64), first))
    new = np.flatnonzero(np.append(True, holders[1:] != holders[:-1]))
    times, holders = np.diff(np.append(new, len(holders))), holders[new]
    edges = np.searchsorted(holders >> np.uint64(32), np.arange(len(sizes) + 1, dtype=np.uint64))
    out = [], [], []
    for g, (a, b) in enumerate(zip(edges.tolist(), edges[1:].tolist())):
        n = int(np.count_nonzero(sizes[g]))
        bits = (holders[a:b, None] >> np.arange(n, dtype=np.uint64) & np.uint64(1)).astype(np.float64)
        shared = (bits * times[a:b, None]).T @ bits
        near = shared >= threshold * (sizes[g, :n, None] + sizes[g, None, :n] - shared)
        least, before = near.argmax(axis=1), None  # of each line the first near one, itself at last
        while before is None or (least != before).any():
            least, before = np.where(near, least, n).min(axis=1), least
        i = np.flatnonzero(least != np.arange(n))
        for x, y in zip(out, (np.full(len(i), g), least[i], i)):
            x.append(y)
    return tuple(np.concatenate(x) for x in out)


def _verified(threshold: float):
    """The links of each group; rows come ordered by group."""

    def links(table: pa.Table) -> pa.RecordBatch:
        ids, lines = table.column("id").to_numpy(), table.column("line").combine_chunks()
        begin, size = _groups(np.arange(len(ids)), table.column("gid").to_numpy())
        length, rows = np.diff(text_bytes(lines)[1]), np.arange(len(ids))
        text = np.add.reduceat(length, begin)
        if (text > LONG).any():  # groups of long lines: pair by pair
            parts = [p for a, n, long in zip(begin.tolist(), size.tolist(), text > LONG) for p in (combinations(range(a, a + n), 2) if long else [range(a, a + n)])]
            rows, size = np.concatenate([np.array(p) for p in parts]), np.array([len(p) for p in parts])
            begin = np.cumsum(size) - size
            text = np.add.reduceat(length[rows], begin)
        found = [np.zeros((0, 2), np.int64)]
        for i, j in _cuts(np.maximum(text, GROUP_CHARS >> 12), GROUP_CHARS):
            part = slice(int(begin[i]), int(begin[j - 1] + size[j - 1]))
            group = np.repeat(np.arange(j - i), size[i:j])
            local = np.arange(part.start, part.stop) - begin[i:j][group]
            g, x, y = _near_pairs(lines.take(pa.array(rows[part])), group, local, threshold)
            at = begin[i:j][g]
            found.append(np.stack([ids[rows[at + x]], ids[rows[at + y]]], axis=1))
        found = np.concatenate(found)
        return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([held, table]) if held is not None else table
            gid = table.column("gid").to_numpy()
            last = int(np.searchsorted(gid, gid[-1])) if len(gid) else 0
            held = table.slice(last)
            if last:
                yield links(table.slice(0, last))
        if held is not None and held.num_rows:
            yield links(held)

    return run


def _linked(threshold: float):
    """Links between the components of a group's lines (of its two sides, if it has two): a spanning forest of all links, never all pairs."""

    def run(table: pa.Table) -> pa.Table:
        ids, component, side = (table.column(c).to_numpy() for c in ("id", "component", "side"))
        values, line = shingles(table.column("line").combine_chunks())
        low, n = np.uint64(44), len(ids)
        keys = np.sort(line.astype(np.uint64) << low | values >> np.uint64(20))
        keys = keys[np.append(True, keys[1:] != keys[:-1])[: len(keys)]]
        line = (keys >> low).astype(np.int64)
        size = np.bincount(line, minlength=n)
        _, place, times = np.unique(keys & np.uint64((1 << 44) - 1), return_inverse=True, return_counts=True)
        place, line = (np.cumsum(times > 1) - 1)[place][times[place] > 1], line[times[place] > 1]
        order = np.argsort(place, kind="stable")
        place, line = place[order], line[order]
        x, y = (np.flatnonzero(side == v) for v in (False, True))
        x, y = (x, y) if len(x) and len(y) else (np.arange(n), np.arange(n))
        shared = np.zeros((len(x), len(y)))
        width = max(64, (1 << 21) // n)  # shingles at once
        for begin in range(0, int(place[-1]) + 1 if len(place) else 0, width):
            i, j = np.searchsorted(place, (begin, begin + width))
            holds = np.zeros((n, width), np.float32)
            holds[line[i:j], place[i:j] - begin] = 1
            shared += holds[x] @ holds[y].T
        near = (shared >= threshold * (size[x][:, None] + size[y][None, :] - shared)) & (component[x][:, None] != component[y][None, :])
        u, v = np.nonzero(near)
        names, no = np.unique(component, return_inverse=True)
        _, first = np.unique(no[x[u]].astype(np.int64) * len(names) + no[y[v]], return_index=True)
        root, links = list(range(len(names))), []
        for a, b in zip(x[u[first]].tolist(), y[v[first]].tolist()):
            c, d = no[a], no[b]
            while root[c] != c:
                c = root[c] = root[root[c]]
            while root[d] != d:
                d = root[d] = root[root[d]]
            if c != d:
                root[max(c, d)] = min(c, d)
                links.append((ids[a], ids[b]))
        return pa.table([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], names=["a", "b"])

    return run


def _blocks(placed: DataFrame, size: int) -> DataFrame:
    """(band, kind, i, j, side, id, component): groups of bounded size in which any two lines of a band and of different components meet.

    Lines of the band's largest component need only meet the others (kind 0), those also each other (kind 1).
    """
    parts = placed.groupBy("band", "component").agg(F.count(F.lit(1)).alias("c"))
    split = parts.groupBy("band").agg(F.max(F.struct("c", "component")).alias("top"), F.sum("c").alias("n"), F.count(F.lit(1)).alias("k")).where("k > 1")
    pieces = lambda n: F.ceil(n / size).cast("int")
    split = split.select("band", F.col("top.component").alias("centre"), pieces(F.col("top.c")).alias("n_top"), pieces(F.col("n") - F.col("top.c")).alias("n_rest"))
    rest = F.col("component") != F.col("centre")
    cut_up = placed.join(split, "band").withColumn("block", F.pmod(F.xxhash64("id", "band"), F.when(rest, F.col("n_rest")).otherwise(F.col("n_top"))).cast("int"))
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    place = lambda kind, i, j, side: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), side.alias("side"))
    block = F.col("block")
    with_top = F.transform(every("n_top"), lambda j: place(0, block, j, F.lit(True)))
    with_rest = F.transform(every("n_rest"), lambda j: place(1, F.least(block, j), F.greatest(block, j), block > j))
    of_top = F.transform(every("n_rest"), lambda i: place(0, i, block, F.lit(False)))
    return cut_up.select("band", "id", "component", F.explode(F.when(rest, F.concat(with_top, with_rest)).otherwise(of_top)).alias("at")).select("band", "at.*", "id", "component")


def documents(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, ids) once an id and text: the id of each line, null for one without a word. Written once."""
    text = F.coalesce("text", F.lit(""))
    ids = F.transform(F.transform(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(EDGE))), lambda x: F.when(x != "", F.xxhash64(x)))
    return cut(docs.select("doc_id", F.xxhash64(text).alias("text_hash"), ids.alias("ids")), tidy=True)


def _texts(docs: DataFrame, every: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, line) of the wanted ids, each from the first place where it stands. Written once."""
    at = F.min(F.struct("doc_id", "text_hash", "line_no")).alias("at")
    places = every.join(wanted, "id", "left_semi").groupBy("id").agg(at).select("id", F.col("at.doc_id").alias("_id"), F.col("at.text_hash").alias("_hash"), F.col("at.line_no").alias("line_no"))
    per_text = places.groupBy("_id", "_hash").agg(F.collect_list(F.struct("id", "line_no")).alias("lines"))
    keyed = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text")
    fetched = keyed.join(per_text.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))).select(F.split("text", "\n").alias("split"), "lines")
    lines = fetched.select("split", F.explode("lines").alias("x")).select("x.id", F.btrim(F.get("split", F.col("x.line_no")), F.lit(EDGE)).alias("line"))
    return cut(lines.dropDuplicates(["id"]), tidy=True)


def _links(docs: DataFrame, every: DataFrame, threshold: float) -> DataFrame:
    """(a, b): links that join the same lines as all links between lines of a band."""
    found = cut(band_groups(docs), tidy=True)
    groups = found.select(F.array_sort("ids").alias("ids")).distinct().select(F.xxhash64("ids").alias("gid"), F.explode("ids").alias("id"))
    lines = _texts(docs, every, groups.select("id").distinct())
    links = cut(groups.join(lines, "id").repartition("gid").sortWithinPartitions("gid").mapInArrow(_verified(threshold), "a long, b long"), tidy=True)
    members = found.where("crowded").select("band", F.explode("ids").alias("id")).distinct()
    if members.isEmpty():
        return links
    joined = components(links).withColumnRenamed("node", "id")
    placed = cut(members.join(joined, "id", "left").withColumn("component", F.coalesce("component", "id")), tidy=True)
    top = placed.groupBy("band", "component").agg(F.count(F.lit(1)).alias("n")).groupBy("band").agg(F.max(F.struct("n", "component")).alias("top"), F.count(F.lit(1)).alias("k"))
    families = placed.join(top.where("k > 1").select("band", F.col("top.component").alias("family")), "band").select(F.col("family").alias("band"), "id", "component").distinct()
    blocks = _blocks(families, BLOCK_LINES).join(lines, "id")
    more = blocks.groupBy("band", "kind", "i", "j").applyInArrow(_linked(threshold), "a long, b long")
    return joined.select(F.col("id").alias("a"), F.col("component").alias("b")).union(more)


def removed_lines(docs: DataFrame, threshold: float = THRESHOLD, by_doc: DataFrame | None = None) -> DataFrame:
    """(doc_id, text_hash, removed: numbers of the lines to drop, in no order), a row an id and text that lose lines. by_doc: documents(docs), if it is there."""
    by_doc = documents(docs) if by_doc is None else by_doc
    every = by_doc.dropDuplicates(["doc_id", "text_hash"]).select("doc_id", "text_hash", F.posexplode("ids").alias("line_no", "id")).where("id IS NOT NULL")
    joined = components(_links(docs, every, threshold)).withColumnRenamed("node", "id")
    first = F.struct("doc_id", "text_hash", "line_no")
    per_id = every.groupBy("id").agg(F.min(first).alias("at"), F.count(F.lit(1)).alias("n")).join(joined, "id", "left").withColumn("component", F.coalesce("component", "id"))
    kept = per_id.groupBy("component").agg(F.min("at").alias("kept"), F.sum("n").alias("n_all")).where("n_all > 1")
    several = per_id.select("id", "component").join(kept, "component").select("id", "kept")
    gone = every.join(several, "id").where(first != F.col("kept"))
    return gone.groupBy("doc_id", "text_hash").agg(F.collect_set("line_no").alias("removed"))


def dedup_lines(docs: DataFrame, threshold: float = THRESHOLD, count: str = "n_removed") -> DataFrame:
    """docs with the lines that stay in text, and their number of lost lines in the column count."""
    gone = removed_lines(docs, threshold).select(F.col("doc_id").alias("_tm_id"), F.col("text_hash").alias("_tm_hash"), F.col("removed").alias("_tm_gone"))
    out = docs.join(gone.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("_tm_id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("_tm_hash")), "left")
    split = out.withColumn("_tm_lines", F.when(F.col("_tm_gone").isNotNull(), F.split("text", "\n")))
    stay = split.withColumn("_tm_stay", F.array_except(F.sequence(F.lit(0), F.size("_tm_lines") - 1), "_tm_gone"))
    text = F.when(F.col("_tm_gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform("_tm_stay", lambda i: F.get("_tm_lines", i)), "\n"))
    return stay.withColumn("text", text).withColumn(count, F.coalesce(F.size("_tm_gone"), F.lit(0))).drop("_tm_id", "_tm_hash", "_tm_gone", "_tm_lines", "_tm_stay")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: for every document the numbers of its lines and of those that go."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    by_doc = documents(docs)
    gone = removed_lines(docs, by_doc=by_doc).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "removed")
    out = by_doc.select("doc_id", "text_hash", F.size("ids").cast("long").alias("n_lines")).join(gone, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left")
    none = F.array().cast("array<int>")
    return out.select("doc_id", "n_lines", F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"), F.array_sort(F.coalesce("removed", none)).alias("removed_lines"))

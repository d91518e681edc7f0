"""Language-model scoring with a probabilistic suffix tree, beside a word-count base score.

A text is read as its lower-cased words, joined by single spaces and closed by
an end symbol. The tree's contexts are the last 0 to DEPTH bytes. A context is
a state if its next-symbol distribution diverges from that of its longest
suffix that is a state: by DIVERGENCE nats a symbol, and by EVIDENCE nats over
all its occurrences, so that chance is ruled out. Nothing else bounds the
states, whose number grows with the training texts. A state's distribution is
smoothed by its suffix's, down to a uniform one. Each symbol is scored by the
longest suffix that is a state, and a text by the sum over its symbols.

Counts cover all training texts: grams and words are counted within a
partition, then summed by buckets, of words by their hashes, of grams by the
last ROOT bytes of their contexts. What is frequent is broadcast: words that
make up HEAD_SHARE of all tokens or more, in training or elsewhere, and
contexts of up to ROOT bytes or of CONTEXT_SHARE of all training symbols or
more (both bounded numbers). Every other word and every symbol after another
context meet their counts in the bucket; a bucket holds all longer contexts
with the same last ROOT bytes, so it settles there which of them are states.

Defined results: a null or empty text has one token, the end; a null id counts
as the empty string; without training texts no token is known and symbols are
equally likely; repeated rows are scored row by row; an empty table gives an
empty result; extra columns are not looked at; the rows are written once with
their numbers, so they may come from any plan.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import starmap

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import cut, shared_folder, text_bytes

DEPTH = 5
#: Contexts up to so many bytes are always broadcast: at most 65,793 for 2. Longer ones share a bucket by so many last bytes.
ROOT = 2
#: Least share of the training symbols of the other broadcast contexts: at most (DEPTH - ROOT) / CONTEXT_SHARE.
CONTEXT_SHARE = 1e-6
#: Least divergence of a state from its suffix, in nats a symbol and in all.
DIVERGENCE, EVIDENCE = 0.01, 30.0
#: Weight of the suffix's distribution, in symbols.
PRIOR = 4.0
HEAD_SHARE = 1e-6
#: Bytes of text whose counts share a bucket, about; buckets at least; bytes that are worked on at once.
BUCKET_BYTES, BUCKETS, BLOCK = 16 << 20, 48, 3 << 19
#: Words and grams that a task holds before it sends their counts on.
HELD = 1_200_000

END = 10
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_RANDOM = np.random.default_rng(3)
_LETTER = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Stands for the end among the words' hashes.
END_WORD = np.uint64(0)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class Stream:
    """A batch of texts: ``word``, the words' hashes, of text number ``of``; ``gram``, the last DEPTH bytes and the next one at each symbol, of text number ``text``."""

    def __init__(self, data: np.ndarray, at: np.ndarray) -> None:
        data, n = _LOWER[data], len(at) - 1
        space = _SPACE[data]
        fresh = np.ones(len(data) + 1, bool)  # whether a word that is here begins here
        fresh[1:] = space
        fresh[at] = True
        begin = np.flatnonzero(~space & fresh[:-1])
        after = np.ones(len(data), bool)
        after[:-1] = space[1:]
        after[at[1:][at[1:] > 0] - 1] = True
        end = np.flatnonzero(~space & after) + 1
        self.of = np.searchsorted(at, begin, "right") - 1
        # arrays of eight bytes a symbol are worked on in place and let go at once: they are most of a task's memory
        total = np.zeros(len(data) + 1, np.uint64)
        hashed = _LETTER[data]
        hashed *= np.cumprod(np.full(len(data), _BASE, np.uint64))
        np.cumsum(hashed, out=total[1:])
        del hashed
        self.word = total[end] - total[begin]
        del total
        self.word *= np.cumprod(np.full(len(data) + 1, _BACK, np.uint64))[begin]
        self.word = np.maximum(_mixed(self.word), np.uint64(1))
        self.n_words = np.bincount(self.of, minlength=n)
        kept = ~space
        later = begin[np.append(False, self.of[1:] == self.of[:-1])[: len(begin)]]
        kept[later - 1] = True  # one space between words
        size = np.add.reduceat(np.append(kept, False), at[:-1], dtype=np.int64) * (np.diff(at) > 0) if n else np.zeros(0, np.int64)
        # before each text DEPTH ends, after it one
        start = np.cumsum(size + DEPTH + 1) - (size + DEPTH + 1)
        line = np.full(int((size + DEPTH + 1).sum()), END, np.uint8)
        self.text = np.repeat(np.arange(n, dtype=np.int32), size + 1)
        symbol = np.ones(len(line), bool)
        symbol[(start[:, None] + np.arange(DEPTH)).ravel()] = False
        inner = symbol.copy()
        inner[start + DEPTH + size] = False
        line[inner] = np.where(space, np.uint8(32), data)[kept]
        gram = np.zeros(len(line), "<u8")
        for i in range(DEPTH + 1):
            gram.view(np.uint8).reshape(-1, 8)[DEPTH:, i] = line[DEPTH - i : len(line) - i]
        self.gram = gram[symbol]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Stream]]:
    for batch in batches:
        data, at = text_bytes(batch.column("text"))
        i = 0
        while i < batch.num_rows:
            j = min(batch.num_rows, max(i + 1, int(np.searchsorted(at, at[i] + BLOCK, "right")) - 1))
            yield batch.slice(i, j - i), Stream(data[at[i] : at[j]], at[i : j + 1] - at[i])
            i = j


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal keys brought together, in order."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[new], np.add.reduceat(counts, new) if len(new) else counts


WORDS, GRAMS = 0, 1
#: Words have counts in training texts and in others, grams in training texts only.
WIDTH = {WORDS: 2, GRAMS: 1}
_COUNTS = "bucket int, kind int, keys binary, counts binary"


def _dealt(keys: np.ndarray, kind: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of the keys by bucket, and where each bucket begins."""
    bucket = (_mixed(keys if kind == WORDS else (keys >> np.uint64(8)) & np.uint64((1 << 8 * ROOT) - 1)) % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.int64)
    return np.argsort(bucket, kind="stable"), np.append(0, np.cumsum(np.bincount(bucket, minlength=buckets)))


def _counted(buckets: int):
    """Counts of words (in training texts, in others) and grams (in training texts) of blocks of a partition, packed by bucket."""

    def packets(held: dict) -> pa.RecordBatch:
        rows = []
        for kind, (keys, counts) in held.items():
            order, edges = _dealt(keys, kind, buckets)
            rows += [(b, kind, keys[order[x:y]].tobytes(), counts[order[x:y]].tobytes()) for b, (x, y) in enumerate(zip(edges, edges[1:])) if y > x]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(list(zip(*rows)) or [()] * 4, (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["bucket", "kind", "keys", "counts"])

    def block(held: dict, batch: pa.RecordBatch, stream: Stream) -> None:
        other = np.asarray(batch.column("held").cast(pa.uint8())).astype(bool)
        words = np.concatenate([stream.word, np.full(len(other), END_WORD)])
        apart = other[np.concatenate([stream.of, np.arange(len(other))])]
        for keys, column, kind in ((words[~apart], 0, WORDS), (words[apart], 1, WORDS), (stream.gram[~other[stream.text]], 0, GRAMS)):
            keys, n = np.unique(keys, return_counts=True)
            counts = np.zeros((len(keys), WIDTH[kind]), np.int64)
            counts[:, column] = n
            held[kind] = _summed(*(np.concatenate(x) for x in zip(held[kind], (keys, counts))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = {k: (np.zeros(0, np.uint64), np.zeros((0, w), np.int64)) for k, w in WIDTH.items()}
        held = dict(none)
        for _ in starmap(partial(block, held), _blocks(batches)):  # no block is held while the next is read
            if sum(len(k) for k, _ in held.values()) > HELD:
                yield packets(held)
                held.update(none)
        yield packets(held)

    return run


def _counts(packed: bytes, kind: int) -> np.ndarray:
    return np.frombuffer(packed, np.int64).reshape(-1, WIDTH[kind])


def _totals(key: tuple, table: pa.Table) -> pa.Table:
    bucket, kind = (k.as_py() for k in key)
    keys, counts = _summed(np.concatenate([np.frombuffer(x, np.uint64) for x in table.column("keys").to_pylist()]), np.concatenate([_counts(x, kind) for x in table.column("counts").to_pylist()]))
    values = (bucket, kind, int((counts[:, 0] > 0).sum()), int(counts[:, 0].sum()), keys.tobytes(), counts.tobytes())
    return pa.table([pa.array([v], t) for v, t in zip(values, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["bucket", "kind", "n_keys", "total", "keys", "counts"])


def corpus_counts(docs: DataFrame, buckets: int) -> DataFrame:
    """Counts over all texts (docs: text, held), in rows of whole buckets: bucket, kind, and of training texts n_keys and total; keys, counts (packed). Written once."""
    return cut(docs.select("text", "held").mapInArrow(_counted(buckets), _COUNTS).groupBy("bucket", "kind").applyInArrow(_totals, "bucket int, kind int, n_keys long, total long, keys binary, counts binary"))


def _unpacked(kind: int, least: float = 1):
    """The keys of a kind that reach a count in any column, with their count in training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, c in zip(batch.column("keys"), batch.column("counts")):
                keys, counts = np.frombuffer(k.as_py(), np.int64), _counts(c.as_py(), kind)
                some = counts.max(axis=1) >= least
                yield pa.RecordBatch.from_arrays([pa.array(keys[some]), pa.array(counts[some, 0])], names=["key", "n"])

    return run


class Tree:
    """States in levels of one depth each, a context's suffixes in earlier levels: contexts in order with their totals, and their next symbols' counts.

    ``decided`` holds the contexts of DEPTH bytes, in order, of which and of whose suffixes it is known here whether they are states.
    """

    def __init__(self, levels: list[tuple], decided: np.ndarray, least: float) -> None:
        self.levels, self.decided, self.least = levels, decided, least

    def log10(self, gram: np.ndarray) -> np.ndarray:
        """log10 probability of each gram's last symbol after the longest suffix that is a state."""
        p = np.full(len(gram), 1 / 256)
        for depth, contexts, totals, grams, counts in self.levels:
            if not len(contexts):
                continue
            mine = gram & np.uint64((1 << 8 * (depth + 1)) - 1)
            total, n = _looked_up(mine >> np.uint64(8), contexts, totals), _looked_up(mine, grams, counts)
            p = np.where(total > 0, (n + PRIOR * p) / (total + PRIOR), p)
        return np.log10(p)

    def add(self, depth: int, grams: np.ndarray, counts: np.ndarray) -> None:
        """A further level: of the contexts of these grams (in order), those that diverge from the tree so far."""
        context = grams >> np.uint64(8)
        new = np.flatnonzero(np.append(True, context[1:] != context[:-1])) if len(grams) else np.zeros(0, np.int64)
        if not len(new):
            return
        size, total = np.diff(np.append(new, len(grams))), np.add.reduceat(counts, new)
        away = np.add.reduceat(counts * (np.log(counts / np.repeat(total, size)) - self.log10(grams) * np.log(10)), new)
        state = (away >= EVIDENCE) & (away >= DIVERGENCE * total) if depth else np.ones(len(new), bool)
        mine = np.repeat(state, size)
        self.levels.append((depth, context[new][state], total[state], grams[mine], counts[mine]))

    def within(self, keys: np.ndarray, counts: np.ndarray) -> Tree:
        """This tree with the states among the contexts that are not broadcast, from the whole counts of a bucket."""
        tree = Tree(list(self.levels), self.decided, self.least)
        for depth in range(ROOT + 1, DEPTH + 1):
            grams, n = _summed(keys & np.uint64((1 << 8 * (depth + 1)) - 1), counts)
            context, which = np.unique(grams >> np.uint64(8), return_inverse=True)
            rare = (np.bincount(which, n, len(context)) < self.least)[which]
            tree.add(depth, grams[rare], n[rare])
        return tree


def _looked_up(keys: np.ndarray, known: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(keys), values.dtype)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, values[at], 0)


def grow(counts: DataFrame, symbols: int, share: float = CONTEXT_SHARE) -> Tree:
    """The broadcast part of the tree. What comes to the driver are the contexts of at most ROOT bytes and those of this share of the symbols, at most (DEPTH - ROOT) / share."""
    least = share * symbols
    grams = counts.where(F.col("kind") == GRAMS).select("keys", "counts").mapInArrow(_unpacked(GRAMS), "key long, n long")
    masks = F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), F.lit((1 << 8 * (d + 1)) - 1).alias("mask")) for d in range(DEPTH + 1)]))
    levels = grams.select("key", "n", masks.alias("m")).groupBy(F.col("m.depth").alias("depth"), F.col("key").bitwiseAND(F.col("m.mask")).alias("gram")).agg(F.sum("n").alias("n"))
    contexts = levels.groupBy("depth", F.shiftright("gram", 8).alias("context")).agg(F.sum("n").alias("total"), F.collect_list(F.struct("gram", "n")).alias("next"))
    rows = contexts.where((F.col("depth") <= ROOT) | (F.col("total") >= least)).select("depth", F.inline("next")).toArrow()
    depth, gram, n = (rows.column(c).to_numpy() for c in ("depth", "gram", "n"))
    gram = gram.astype(np.uint64)
    tree = Tree([], np.unique(gram[depth == DEPTH] >> np.uint64(8)), least)
    for d in range(DEPTH + 1):
        here = np.flatnonzero(depth == d)
        here = here[np.argsort(gram[here])]
        tree.add(d, gram[here], n[here])
    return tree


def held_out(doc_id: Column) -> Column:
    """Rows that are scored only."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


_ENTRY = np.dtype([("key", "<u8"), ("text", "<u4")])
_SUMS = np.dtype([("base", "<f8"), ("known", "<i8"), ("tokens", "<i8"), ("score", "<f8")])
_PACKET = "bucket int, kind int, keys binary, counts binary, rows binary, held binary, entries binary, sums binary"
_PACKET_NAMES = [c.split()[0] for c in _PACKET.split(", ")]
_RESULT = "row_no long, base double, known long, tokens long, score double"


def _result(rows: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows), *[pa.array(np.ascontiguousarray(sums[c])) for c in _SUMS.names]], names=["row_no", *_SUMS.names])


def _scored(model, buckets: int):
    """What is known of a text by the broadcast; the other words and symbols, packed by bucket. A text's sums ride along with words."""

    def block(batch: pa.RecordBatch, stream: Stream) -> pa.RecordBatch:
        tree, head, head_n = model.value
        n, out = batch.num_rows, []
        rows, held = np.asarray(batch.column("row_no")), np.asarray(batch.column("held").cast(pa.uint8()))
        ends = _looked_up(np.array([END_WORD]), head, head_n)[0]
        c, frequent = _looked_up(stream.word, head, head_n), _looked_up(stream.word, head, np.ones(len(head), bool)).astype(bool)
        grams, which = np.unique(stream.gram, return_inverse=True)
        far = ~_looked_up(grams >> np.uint64(8), tree.decided, np.ones(len(tree.decided), bool)).astype(bool)
        log10 = np.zeros(len(grams))
        log10[~far] = tree.log10(grams[~far])
        sums = np.zeros(n, _SUMS)
        sums["base"] = np.bincount(stream.of, np.where(frequent, np.log10(c + 1.0), 0), n) + np.log10(ends + 1.0)
        sums["known"] = np.bincount(stream.of[c > 0], minlength=n) + int(ends > 0)
        sums["tokens"], sums["score"] = stream.n_words + 1, np.bincount(stream.text, log10[which], n)
        rare, far = np.flatnonzero(~frequent), np.flatnonzero(far[which])
        del grams, which, log10, c, frequent
        home, starts = _dealt(rows.view(np.uint64), WORDS, buckets)
        for kind, keys, text in ((WORDS, stream.word[rare], stream.of[rare]), (GRAMS, stream.gram[far], stream.text[far])):
            order, edges = _dealt(keys, kind, buckets)
            for b, (x, y) in enumerate(zip(edges, edges[1:])):
                mine = home[starts[b] : starts[b + 1]] if kind == WORDS else np.zeros(0, np.int64)
                used, local = np.unique(np.concatenate([mine, text[order[x:y]]]), return_inverse=True)
                if not len(used):
                    continue
                entries = np.zeros(y - x, _ENTRY)
                entries["key"], entries["text"] = keys[order[x:y]], local[len(mine) :]
                own = np.zeros(len(used), _SUMS)
                own[local[: len(mine)]] = sums[mine]
                out.append((b, kind, None, None, rows[used].tobytes(), held[used].tobytes(), entries.tobytes(), own.tobytes() if kind == WORDS else None))
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(list(zip(*out)) or [()] * 8, (pa.int32(), pa.int32(), *[pa.binary()] * 6))], names=_PACKET_NAMES)

    return lambda batches: starmap(block, _blocks(batches))  # no block is held while the next is read


def _met(model):
    def words(packets: list[dict]) -> pa.RecordBatch:
        """A bucket's rare words meet their counts in the training texts, which are all here."""
        rows, held, sums, entries, n = [], [], [], [], 0
        for x in packets:
            entries.append(np.frombuffer(x["entries"], _ENTRY).copy())
            entries[-1]["text"] += n
            for to, k, t in ((rows, "rows", np.int64), (held, "held", np.uint8), (sums, "sums", _SUMS)):
                to.append(np.frombuffer(x[k], t))
            n += len(rows[-1])
        held, sums, entries = np.concatenate(held), np.concatenate(sums).copy(), np.concatenate(entries)
        distinct, which = np.unique(entries["key"], return_inverse=True)
        c = np.bincount(which, held[entries["text"]] == 0, len(distinct))[which] if len(entries) else np.zeros(0)
        sums["base"] += np.bincount(entries["text"], np.log10(c + 1), n)
        sums["known"] += np.bincount(entries["text"], c > 0, n).astype(np.int64)
        return _result(np.concatenate(rows), sums)

    def symbols(tree: Tree, x: dict) -> pa.RecordBatch:
        rows, entries = np.frombuffer(x["rows"], np.int64), np.frombuffer(x["entries"], _ENTRY)
        grams, which = np.unique(entries["key"], return_inverse=True)
        sums = np.zeros(len(rows), _SUMS)
        sums["score"] = np.bincount(entries["text"], tree.log10(grams)[which], len(rows))
        return _result(rows, sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A bucket of words, which is held, or of grams: their counts come first, then one packet after the other is scored."""
        held, tree = [], None
        for batch in batches:
            for x in (r for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
                if x["kind"] == WORDS:
                    held.append(x)
                elif x["keys"] is not None:
                    if tree is not None:
                        raise ValueError("counts of a bucket must come before its packets")
                    tree = model.value[0].within(np.frombuffer(x["keys"], np.uint64), _counts(x["counts"], GRAMS)[:, 0])
                else:
                    tree = tree or model.value[0]
                    yield symbols(tree, x)
        if held:
            yield words(held)

    return run


def score(docs: DataFrame, training: Column | None = None, share: float = CONTEXT_SHARE) -> DataFrame:
    """A row a document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. training: the rows to learn from. share: what a context makes up to be broadcast (no matter for the result)."""
    held = held_out(F.col("doc_id")) if training is None else ~training
    # rows are numbered once and written with their numbers: behind a shuffle a second evaluation numbers them otherwise
    at = shared_folder(docs.sparkSession)
    docs.select(F.monotonically_increasing_id().alias("row_no"), "doc_id", held.alias("held"), "text").write.parquet(at)
    rows = docs.sparkSession.read.parquet(at)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(BUCKETS, size // BUCKET_BYTES)
    counts = corpus_counts(rows.select("text", "held"), buckets)
    totals = {r["kind"]: r for r in counts.groupBy("kind").agg(F.sum("n_keys").alias("n_keys"), F.sum("total").alias("total")).collect()}
    tokens, distinct = (totals[WORDS]["total"], totals[WORDS]["n_keys"]) if totals else (0, 0)
    tree = grow(counts, totals[GRAMS]["total"] if GRAMS in totals else 0, share)
    head = counts.where(F.col("kind") == WORDS).select("keys", "counts").mapInArrow(_unpacked(WORDS, max(1, HEAD_SHARE * tokens)), "key long, n long").toArrow()
    keys, n = (head.column(c).to_numpy() for c in ("key", "n"))
    order = np.argsort(keys.view(np.uint64))
    model = rows.sparkSession.sparkContext.broadcast((tree, keys.view(np.uint64)[order], n[order]))
    packets = rows.select("row_no", "held", "text").mapInArrow(_scored(model, buckets), _PACKET)
    known = counts.where(F.col("kind") == GRAMS).select("bucket", "kind", "keys", "counts", *[F.lit(None).cast("binary").alias(c) for c in _PACKET_NAMES[4:]])
    dealt = packets.unionByName(known).repartition("bucket", "kind").sortWithinPartitions("bucket", "kind", F.col("keys").isNull())
    by_row = dealt.groupBy("bucket", "kind").applyInArrow(_met(model), _RESULT).groupBy("row_no").agg(*[F.sum(c).alias(c) for c in _SUMS.names])
    least = float(np.log10(tokens + distinct + 1.0))
    return rows.select("row_no", "doc_id", "held").join(by_row, "row_no").select(
        "doc_id", F.col("held").alias("held_out"), F.col("tokens").alias("n_tokens"), F.col("known").alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("tokens") * F.lit(least)).alias("base_score"), "score",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: scores of every document."""
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A word's input is its own embedding beside the mean of its byte trigrams'
embeddings, so unseen forms of a known stem are known too. Windows of WINDOW
words, each half over the next, are scored one by one; a document's score is
that of its worst window, so whole texts count whatever their length.

The network is trained on a bounded sample of labelled rows (MAX_ROWS clean
ones and half as many toxic ones, by a hash of the id; of texts over MAX_CHARS
characters, which are drawn last, a piece of that length). A label says
only that some window of a toxic document is toxic: training starts from the
window with the most telling words and then goes over to the window that the
network itself finds worst, together with the worst windows of clean documents.

Defined results: a null or empty text and one without words score 0; null
and repeated ids are ordinary rows; without labelled rows of both classes every
score is 0; an empty table gives an empty result; only text is an input of a
score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import text_bytes

WINDOW, STRIDE = 24, 12
HIDDEN, EMBED = 8, 8
WORD_BUCKETS, TRIGRAM_BUCKETS = 1 << 15, 1 << 13
#: Clean labelled rows that the network is fitted on (of toxic ones half as many), and the length of the longest of them.
MAX_ROWS, MAX_CHARS = 1500, 3000
#: What a window's logit must exceed: the worst of a text's many windows counts, so chance must be kept out.
MARGIN = 0.8
#: Training rounds; each chooses its windows anew.
ROUNDS, BATCH, RATE = 6, 256, 0.01
#: Windows that are scored at once; bytes of text that are worked on at once.
BLOCK, BYTES = 2048, 1 << 20
#: Bytes of text, or words of it, whose long arrays are held at once.
PIECE = 1 << 17

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)
_POWER = np.uint64(0x100000001B3 * 0x5851F42D4C957F2D % (1 << 64) | 1)
_INVERSE = np.uint64(pow(int(_POWER), -1, 1 << 64))
_LETTER = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)


class Words:
    """The words (ASCII letters and digits, lower-cased, and all bytes beyond ASCII) of a batch of texts.

    ``doc``: where each text's words begin; ``which``: each word's place among the distinct ones;
    ``bucket``: a distinct word's row of the embedding; ``grams`` from ``at``: rows of its trigrams.
    """

    def __init__(self, data: np.ndarray, at: np.ndarray) -> None:
        lower = data.tobytes().translate(_LOWER.tobytes())  # an index would first become eight bytes a byte
        data, word = np.frombuffer(lower, np.uint8), np.frombuffer(lower.translate(_WORD.tobytes()), bool)
        del lower
        inside = np.zeros(len(data) + 1, bool)  # whether the byte before belongs to the same text and is part of a word
        inside[1:] = word
        inside[at] = False
        begin = np.flatnonzero(word & ~inside[:-1])
        after = np.ones(len(data), bool)
        after[:-1] = ~word[1:]
        after[at[1:][at[1:] > 0] - 1] = True
        end = np.flatnonzero(word & after) + 1
        self.doc = np.searchsorted(begin, at)
        with np.errstate(over="ignore"):
            # sums of letters times powers of their places, a piece of the texts at a time
            hashed, i = np.empty(len(begin), np.uint64), 0
            while i < len(begin):
                a = begin[i]
                j = max(i + 1, int(np.searchsorted(end, a + PIECE, "right")))
                b, e = begin[i:j] - a, end[i:j] - a
                total = np.cumprod(np.full(e[-1], _POWER, np.uint64))
                total *= _LETTER[data[a : a + e[-1]]]
                np.cumsum(total, out=total)
                hashed[i:j] = total[e - 1] - np.where(b > 0, total[b - 1], np.uint64(0))
                hashed[i:j] *= np.cumprod(np.full(e[-1], _INVERSE, np.uint64))[b]
                i = j
            hashed ^= hashed >> np.uint64(29)
            hashed *= _ODD
        distinct, first, self.which = np.unique(hashed, return_index=True, return_inverse=True)
        self.bucket = (distinct >> np.uint64(40)).astype(np.int64) % WORD_BUCKETS
        begin, end = begin[first], end[first]
        size = end - begin
        self.at = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64) if len(size) else np.zeros(0, np.int64)
        place = np.arange(size.sum()) - np.repeat(self.at, size) + np.repeat(begin, size)
        padded = np.zeros(len(data) + 2, np.uint8)
        padded[1:-1] = data
        left, here, right = (padded[place + k].astype(np.uint64) for k in range(3))
        left[place == np.repeat(begin, size)] = 0
        right[place == np.repeat(end, size) - 1] = 0
        with np.errstate(over="ignore"):
            self.grams = (((left << np.uint64(16) | here << np.uint64(8) | right) * _ODD) >> np.uint64(44)).astype(np.int64) % TRIGRAM_BUCKETS
        self.size = size

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """(places of each window's words among the distinct ones, one past the last for padding; the text of each window)."""
        n = np.diff(self.doc)
        count = np.where(n > 0, 1 + np.maximum(0, -(-(n - WINDOW) // STRIDE)), 0)
        text = np.repeat(np.arange(len(n)), count)
        order = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        start = self.doc[:-1][text] + order * STRIDE
        place = start[:, None] + np.arange(WINDOW)
        padding = place >= self.doc[1:][text][:, None]
        which = np.append(self.which, 0).astype(np.int32)
        out = which[np.where(padding, len(which) - 1, place)]
        out[padding] = len(self.bucket)
        return out, text


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Embeddings, a recurrent layer each way, attention over the words, one output."""

    def __init__(self, seed: int = 11) -> None:
        g = np.random.default_rng(seed)
        new = lambda *s, scale: (g.standard_normal(s) * scale).astype(np.float32)
        h, d = HIDDEN, 2 * EMBED
        self.p = {"word": new(WORD_BUCKETS, EMBED, scale=0.1), "gram": new(TRIGRAM_BUCKETS, EMBED, scale=0.3)}
        for way in "fb":
            self.p |= {f"W{way}": new(d, 3 * h, scale=0.4), f"b{way}": np.zeros(3 * h, np.float32), f"U{way}": new(h, 3 * h, scale=0.3), f"c{way}": np.zeros(h, np.float32)}
        self.p |= {"A": new(2 * h, h, scale=0.3), "a": np.zeros(h, np.float32), "v": new(h, scale=0.5), "out": new(2 * h, scale=0.5), "bias": np.zeros(1, np.float32)}

    def inputs(self, bucket: np.ndarray, grams: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """A row for each distinct word, and a last one of zeros for padding."""
        x = np.zeros((len(bucket) + 1, 2 * EMBED), np.float32)
        if len(bucket):
            x[:-1, :EMBED] = self.p["word"][bucket]
            x[:-1, EMBED:] = np.add.reduceat(self.p["gram"][grams], at, axis=0) / size[:, None]
        return x

    def layer(self, way: str, table: np.ndarray, index: np.ndarray, mask: np.ndarray, kept: list | None) -> np.ndarray:
        """States (words, windows, HIDDEN) of one direction. table: inputs times weights, a row for each distinct word."""
        h, u, c = HIDDEN, self.p[f"U{way}"], self.p[f"c{way}"]
        state = np.zeros((len(index), h), np.float32)
        states = np.empty((index.shape[1], len(index), h), np.float32)
        for t in range(index.shape[1]) if way == "f" else range(index.shape[1] - 1, -1, -1):
            x, s = table[index[:, t]], state @ u
            zr = _sigmoid(x[:, : 2 * h] + s[:, : 2 * h])
            z, r, inner = zr[:, :h], zr[:, h:], s[:, 2 * h :] + c
            n = np.tanh(x[:, 2 * h :] + r * inner)
            new = n + z * (state - n)
            if kept is not None:
                kept.append((t, state, z, r, n, inner))
            state = np.where(mask[:, t, None], new, state)
            states[t] = state
        return states

    def attend(self, states: np.ndarray, mask: np.ndarray):
        u = np.tanh(states @ self.p["A"] + self.p["a"])
        s = np.where(mask.T, u @ self.p["v"], -30.0)
        e = np.exp(s - s.max(axis=0))
        weight = e / e.sum(axis=0)
        pooled = np.einsum("tb,tbh->bh", weight, states)
        return u, weight, pooled, pooled @ self.p["out"] + self.p["bias"]

    def score(self, words: Words, windows: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(logit of every window, its words, its text)."""
        index, text = windows or words.windows()
        x = self.inputs(words.bucket, words.grams, words.at, words.size)
        tables = {way: x @ self.p[f"W{way}"] + self.p[f"b{way}"] for way in "fb"}
        out = np.empty(len(index), np.float32)
        for i in range(0, len(index), BLOCK):
            part = index[i : i + BLOCK]
            mask = part < len(words.bucket)
            states = np.concatenate([self.layer(way, tables[way], part, mask, None) for way in "fb"], axis=2)
            out[i : i + BLOCK] = self.attend(states, mask)[3]
        return out, index, text

    def gradients(self, x: np.ndarray, index: np.ndarray, pad: int, label: np.ndarray) -> tuple[float, dict, np.ndarray]:
        """(loss, gradients of all but the embeddings, gradient of x), x a row for each distinct word."""
        p, h, mask = self.p, HIDDEN, index < pad
        kept: dict[str, list] = {"f": [], "b": []}
        tables = {way: x @ p[f"W{way}"] + p[f"b{way}"] for way in "fb"}
        states = np.concatenate([self.layer(way, tables[way], index, mask, kept[way]) for way in "fb"], axis=2)
        u, weight, pooled, logit = self.attend(states, mask)
        prob = _sigmoid(logit)
        loss = float(-np.mean(np.log(np.where(label > 0, prob, 1 - prob) + 1e-7)))
        d = ((prob - label) / len(label)).astype(np.float32)
        g = {"out": pooled.T @ d, "bias": d.sum(keepdims=True)}
        dp = d[:, None] * p["out"]
        dw = np.einsum("bh,tbh->tb", dp, states)
        ds = weight * (dw - (weight * dw).sum(axis=0)) * mask.T
        du = ds[:, :, None] * p["v"] * (1 - u * u)
        g |= {"v": np.einsum("tb,tbh->h", ds, u), "A": np.einsum("tbi,tbj->ij", states, du), "a": du.sum(axis=(0, 1))}
        dh = weight[:, :, None] * dp + du @ p["A"].T
        dx = np.zeros_like(x)
        for k, way in enumerate("fb"):
            U = p[f"U{way}"]
            gU, gc, carry = np.zeros_like(U), np.zeros(h, np.float32), np.zeros((len(index), h), np.float32)
            dtable = np.zeros_like(tables[way])
            for t, state, z, r, n, inner in reversed(kept[way]):
                at = carry + dh[t, :, k * h : k * h + h]
                m = mask[:, t, None]
                new, carry = at * m, at * ~m
                dn = new * (1 - z) * (1 - n * n)
                dz, dr, di = new * (state - n) * z * (1 - z), dn * inner * r * (1 - r), dn * r
                pre = np.concatenate([dz, dr, di], axis=1)
                carry += new * z + pre @ U.T
                gU += state.T @ pre
                gc += di.sum(axis=0)
                np.add.at(dtable, index[:, t], np.concatenate([dz, dr, dn], axis=1))
            dtable[pad] = 0
            g |= {f"W{way}": x.T @ dtable, f"b{way}": dtable.sum(axis=0), f"U{way}": gU, f"c{way}": gc}
            dx += dtable @ p[f"W{way}"].T
        return loss, g, dx


class Adam:
    def __init__(self, p: dict[str, np.ndarray]) -> None:
        self.m, self.v, self.n = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0

    def step(self, p: dict[str, np.ndarray], g: dict[str, np.ndarray], rate: float) -> None:
        self.n += 1
        for k, x in g.items():
            self.m[k] += 0.1 * (x - self.m[k])
            self.v[k] += 0.001 * (x * x - self.v[k])
            p[k] -= rate * (self.m[k] / (1 - 0.9**self.n)) / (np.sqrt(self.v[k] / (1 - 0.999**self.n)) + 1e-7)


def _telling(words: Words, label: np.ndarray) -> np.ndarray:
    """For each distinct word, how much more often toxic texts hold it, or the most telling of its trigrams (log odds)."""
    counts = {"word": np.zeros((2, len(words.bucket))), "gram": np.zeros((2, TRIGRAM_BUCKETS))}

    def count(kind: str, keys: np.ndarray, texts: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Adds each key of a text once; (those keys, their texts)."""
        key, at = np.divmod(np.unique(keys * len(part) + texts), len(part))
        for row, of in zip(counts[kind], (part, 1 - part), strict=True):
            row += np.bincount(key, of[at], len(row))
        return key, at

    edges = np.unique(np.append(np.searchsorted(words.doc, np.arange(0, words.doc[-1], PIECE)), len(label)))
    for i, j in zip(edges[:-1], edges[1:], strict=True):  # a text's words meet only its own
        key, at = count("word", words.which[words.doc[i] : words.doc[j]], np.repeat(np.arange(j - i), np.diff(words.doc[i : j + 1])), label[i:j])
        size = words.size[key]
        ends = np.cumsum(size)
        flat = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size, size) + np.repeat(words.at[key], size)
        count("gram", words.grams[flat], np.repeat(at, size), label[i:j])
    odds = lambda yes, no: np.where(yes + no >= 4, np.log((yes + 0.5) * (1 - label).sum() / ((no + 0.5) * label.sum())), 0)
    own, grams = odds(*counts["word"]), odds(*counts["gram"])
    return np.maximum(own, np.maximum.reduceat(grams[words.grams], words.at)) if len(words.bucket) else own


def train(texts: list[str], labels: list[int], rounds: int = ROUNDS, seed: int = 11) -> Network:
    """Fit a network on labelled texts (a bounded sample)."""
    net, g = Network(seed), np.random.default_rng(seed)
    label = np.array(labels, np.float32)
    words = Words(*text_bytes(pa.array(texts, pa.string())))
    index, text = words.windows()
    if not len(index) or not 0 < label.sum() < len(label):
        net.p["bias"][:] = -30
        return net
    adam, pad = Adam(net.p), len(words.bucket)
    first = np.flatnonzero(np.diff(text, prepend=-1))
    worst = np.append(_telling(words, label), -30.0)[index].max(axis=1)
    for no in range(rounds):
        if no:
            worst = net.score(words, (index, text))[0]
        best = np.maximum.reduceat(worst, first)
        near = worst >= np.repeat(best, np.diff(np.append(first, len(text)))) - 1e-6
        toxic = np.flatnonzero(near & (label[text] > 0))
        clean = np.concatenate([np.flatnonzero(near & (label[text] == 0)), g.choice(np.flatnonzero(label[text] == 0), 4 * len(toxic))])
        chosen = g.permutation(np.concatenate([toxic, clean]))
        for i in range(0, len(chosen), BATCH):
            part = index[chosen[i : i + BATCH]]
            used, local = np.unique(np.append(part, pad), return_inverse=True)
            local, used = local[:-1].reshape(part.shape), used[:-1]
            size = words.size[used]
            at = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)
            flat = np.arange(size.sum()) - np.repeat(at, size) + np.repeat(words.at[used], size)
            grams, bucket = words.grams[flat], words.bucket[used]
            x = net.inputs(bucket, grams, at, size)
            seen = (g.random(len(used)) > 0.25).astype(np.float32)[:, None]  # now and then a word has to be known by its letters
            x[:-1, :EMBED] *= seen
            _, grad, dx = net.gradients(x, local, len(used), label[text[chosen[i : i + BATCH]]])
            grad["word"], grad["gram"] = np.zeros_like(net.p["word"]), np.zeros_like(net.p["gram"])
            np.add.at(grad["word"], bucket, dx[:-1, :EMBED] * seen)
            np.add.at(grad["gram"], grams, np.repeat(dx[:-1, EMBED:] / size[:, None], size, axis=0))
            adam.step(net.p, grad, RATE * (1 - 0.8 * no / rounds))
    net.p["bias"] -= MARGIN
    return net


def held_out(doc_id):
    """Rows that no label may be learned from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS) -> Network:
    """A network trained on at most max_rows clean and half as many toxic labelled texts that are not held out.

    Labels are drawn in the order of a hash of their ids, from those whose documents are there and
    hold text; texts beyond max_chars come last, and then a piece of max_chars of each. As a bounded
    table the draw is broadcast to the documents, so no text is shuffled.
    """
    usable = labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    there = docs.select("doc_id", F.length("text").alias("n")).where("n > 0").groupBy("doc_id").agg(F.min("n").alias("n")).join(usable, "doc_id")
    order = F.xxhash64("doc_id")
    draw = lambda c: there.where(F.col("toxic") == c).orderBy(F.col("n") > max_chars, order, "doc_id").limit(max_rows // (1 + c))
    drawn = draw(0).unionByName(draw(1))
    start = F.when(F.length("text") > max_chars, 1 + F.pmod(F.xxhash64("doc_id", F.lit(1)), F.length("text") - max_chars + 1)).otherwise(1).cast("int")
    texts = docs.select("doc_id", "text").where(F.length("text") > 0).join(F.broadcast(drawn), "doc_id")
    texts = texts.groupBy("doc_id", "toxic").agg(F.min(F.substring(F.col("text"), start, F.lit(max_chars))).alias("text"))
    rows = sorted({(r["toxic"], r["text"]) for r in texts.select("toxic", "text").toArrow().to_pylist()})
    return train([t for _, t in rows], [c for c, _ in rows])


def score(docs: DataFrame, net: Network, keep: tuple[str, ...] = ("doc_id",), name: str = "score") -> DataFrame:
    """The columns in keep and the score, under a name that is not among them, a row a document. Only the texts go to Python, and only scores come back."""

    @F.arrow_udf("double")
    def worst(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            out = np.zeros(len(batch))
            data, at = text_bytes(batch)
            i = 0
            while i < len(batch):  # texts of about BYTES together, or one long one
                j = min(len(batch), max(i + 1, int(np.searchsorted(at, at[i] + BYTES, "right")) - 1))
                logit, _, text = net.score(Words(data[at[i] : at[j]], at[i : j + 1] - at[i]))
                np.maximum.at(out, i + text, _sigmoid(logit.astype(np.float64)))
                i = j
            yield pa.array(out)

    return docs.select(*keep, worst.asNondeterministic()(F.col("text")).alias(name))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: score and prediction of every document."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = score(docs, fit(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

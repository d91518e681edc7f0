"""The network: gradients, held-out accuracy on the driver's labels, odd cases."""

import os
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidemark.llm import toxicity as T
from tidemark.llm.common import text_bytes


def test_gradients():
    g = np.random.default_rng(0)
    net = T.Network(3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x = g.standard_normal((11, 2 * T.EMBED))
    x[-1] = 0
    index, label = g.integers(0, 10, (5, 6)), np.array([1, 0, 1, 0, 1.0])
    index[0, 4:] = 10
    _, grad, dx = net.gradients(x, index, 10, label)
    loss = lambda: net.gradients(x, index, 10, label)[0]
    for array, got in [*((net.p[k], v) for k, v in grad.items()), (x, dx)]:
        place = np.unravel_index(g.integers(array.size - T.EMBED * 2 if array is x else array.size), array.shape)
        kept, step = array[place], 1e-4
        array[place] = kept + step
        up = loss()
        array[place] = kept - step
        down = loss()
        array[place] = kept
        assert abs((up - down) / (2 * step) - got[place]) < 2e-4 + 0.01 * abs(got[place])


def test_words():
    texts = ["Hello, hello WORLD!", "", None, "ünï x1", "hello"]
    words = T.Words(*text_bytes(pa.array(texts, pa.string())))
    assert np.diff(words.doc).tolist() == [3, 0, 0, 2, 1]
    assert words.which[0] == words.which[1] == words.which[5] and len(set(words.which.tolist())) == 4


def test_windows_cover_whole_texts():
    words = T.Words(*text_bytes(pa.array([" ".join(f"w{i}" for i in range(n)) for n in (1, 24, 25, 100)])))
    index, text = words.windows()
    for t in range(4):
        got = set(index[text == t].ravel().tolist()) - {len(words.bucket)}
        assert got == set(words.which[words.doc[t] : words.doc[t + 1]].tolist())


def test_sample_is_filled(spark, monkeypatch):
    """From labels without documents and from texts over the length nothing is lost but their rest."""
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(100))) for i in range(400)] + [(500, "short"), (None, "x"), (401, ""), (402, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(403)] + [(1000 + i, 1) for i in range(500)] + [(None, 1), (3, None), (500, 1)], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(T, "train", lambda texts, labels: seen.append((texts, labels)))
    T.fit(docs, labels, max_rows=60, max_chars=200)
    texts, classes = seen[0]
    assert (classes.count(0), classes.count(1)) == (60, 30) and "short" in texts and {len(t) for t in texts} == {5, 200}


def test_held_out_accuracy(spark):
    at = os.environ.get("TEST_LABELS_DIR", "/root/testdata/sf0.1")
    docs, labels = (spark.read.parquet(f"{at}/{t}.parquet") for t in ("documents", "labels"))
    net = T.fit(docs, labels)
    test = labels.where(T.held_out(F.col("doc_id"))).select("doc_id", "toxic")
    rows = T.score(docs.join(test, "doc_id"), net, keep=("doc_id", "toxic")).collect()
    # of these labels one toxic in ten marks a text without any toxic word
    toxic, clean = [r.score for r in rows if r.toxic], [r.score for r in rows if not r.toxic]
    assert len(toxic) > 50 and sum(s >= 0.5 for s in toxic) >= 0.85 * len(toxic) and sum(s < 0.5 for s in clean) >= 0.98 * len(clean)


def test_odd_cases(spark, docs, empty):
    net = T.train(["you idiot fool"] * 5 + ["a fine day"] * 5, [1] * 5 + [0] * 5, rounds=1)
    out = T.score(docs, net)
    assert out.count() == docs.count() and all(0 <= r.score <= 1 for r in out.collect())
    assert {r.score for r in out.where("doc_id IN (40, 41, 42)").collect()} == {0.0}
    assert T.score(empty, net).count() == 0
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r.score < 0.5 for r in T.score(docs, T.fit(docs, none)).collect())


def _many_texts(n, words=400):
    g = np.random.default_rng(5)
    return [" ".join(f"word{x}" for x in g.integers(0, 3000, words)) for _ in range(n)], [i % 3 == 0 for i in range(n)]


def test_training_holds_pieces():
    """The driver trains: no long array of the whole sample's bytes or trigrams may be held."""
    texts, labels = _many_texts(800)
    words = T.Words(*text_bytes(pa.array(texts, pa.string())))
    peaks = []
    for work in (lambda: T.Words(*text_bytes(pa.array(texts, pa.string()))), lambda: T._telling(words, np.array(labels, np.float32))):
        tracemalloc.start()
        work()
        peaks.append(tracemalloc.get_traced_memory()[1] / sum(map(len, texts)))
        tracemalloc.stop()
    assert max(peaks) < 16, peaks


def test_pieces_give_the_same(monkeypatch):
    """Hashes and log odds against plain loops, whatever the size of a piece."""
    texts, labels = _many_texts(12, 30)
    texts, labels = [*texts, "", None, "x" * 500, " ünï  word1!"], [*labels, 1, 0, 1, 0]
    label, seen = np.array(labels, np.float32), []
    for piece in (1, 7, 300, 1 << 20):
        monkeypatch.setattr(T, "PIECE", piece)
        words = T.Words(*text_bytes(pa.array(texts, pa.string())))
        seen.append((words.bucket.tolist(), words.which.tolist(), T._telling(words, label).tolist()))
    assert all(s == seen[0] for s in seen)
    inside = [set(words.which[a:b].tolist()) for a, b in zip(words.doc[:-1], words.doc[1:], strict=True)]
    grams = [set(words.grams[a : a + n].tolist()) for a, n in zip(words.at, words.size, strict=True)]

    def odds(held):
        yes, no = sum(h and c for h, c in zip(held, labels, strict=True)), sum(h and not c for h, c in zip(held, labels, strict=True))
        return np.log((yes + 0.5) * (len(labels) - sum(labels)) / ((no + 0.5) * sum(labels))) if yes + no >= 4 else 0

    there = [set().union(*(grams[w] for w in ws)) for ws in inside]
    want = [max(odds([w in ws for ws in inside]), *(odds([x in t for t in there]) for x in grams[w])) for w in range(len(words.bucket))]
    assert np.allclose(seen[0][2], want)

"""Whole results of the learned operators against plain loops: posteriors of the voting rules, scores of the toxicity network."""

import collections
import math
import re

import numpy as np
import pytest

from tidemark.llm import quality_rules as Q
from tidemark.llm import toxicity as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def votes(text):
    """Each rule's vote on a text, in the rules' order, and whether the base rule fails."""
    t = text or ""
    w = WORD.findall(t)
    n = max(1, len(w))
    lines = [x for x in t.split("\n") if WORD.search(x)]
    windows = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = len({j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)})
    upper, letters = sum("A" <= c <= "Z" for c in t), sum(c.isascii() and c.isalpha() for c in t)
    length, shouting = sum(map(len, w)) / n, upper / max(letters, 1)
    symbols, twice = sum(c in "#*$%&|<>" for c in t) / n, len(lines) - len(set(lines))
    common = sum(x.lower() in Q.COMMON for x in w) / n
    bare = sum(not any(c.isalpha() or c.isnumeric() for c in x) for x in w)
    ended = sum(bool(re.search(r"[.!?][\x20\x09-\x0D]*$", x)) for x in lines)
    vote = lambda bad, good: -1 if bad else 1 if good else 0
    return (
        vote(len(w) < 20, len(w) >= 50), vote(symbols > 0.1, symbols < 0.02), vote(covered / n > 0.2, covered / n < 0.05), vote(twice > 0.3 * len(lines), twice == 0), vote(shouting > 0.4, shouting < 0.15),
        vote(length > 12 or length < 2.5, 3 <= length <= 9), vote(common < 0.04, common > 0.12), vote(bare / n > 0.1, bare == 0), vote(ended < 0.3 * len(lines), ended > 0.7 * len(lines)),
    ), len(w) < 20 or 100 * covered > 30 * len(w)


def posteriors(all_votes):
    """Expectation-maximisation, document by document."""
    n_rules = len(all_votes[0])
    prior, good, bad = 0.8, [0.8] * n_rules, [0.8] * n_rules

    def p(v):
        odds = math.log(prior / (1 - prior))
        for x, a, b in zip(v, good, bad):
            odds += math.log(a / (1 - b)) if x == 1 else math.log((1 - a) / b) if x == -1 else 0.0
        return 1 / (1 + math.exp(-odds))

    for _ in range(Q.ROUNDS):
        ps = [p(v) for v in all_votes]
        rate = lambda weight, i, x: (sum(w for w, v in zip(weight, all_votes) if v[i] == x) + 1) / (sum(w for w, v in zip(weight, all_votes) if v[i]) + 2)
        now = [rate(ps, i, 1) for i in range(n_rules)], [rate([1 - x for x in ps], i, -1) for i in range(n_rules)]
        moved = max(abs(x - y) for new, old in zip(now, (good, bad)) for x, y in zip(new, old))
        prior, (good, bad) = (sum(ps) + 1) / (len(ps) + 2), now
        if moved < Q.TOLERANCE:
            break
    return [p(v) for v in all_votes]


def test_quality_verdicts(spark, rows, sf_dir):
    given = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    for table in (given, [(r[0], r[1]) for r in rows]):
        judged = [votes(t) for _, t in table]
        want = collections.Counter((i, round(p, 6), failed, not failed and p >= 0.5) for (i, _), (_, failed), p in zip(table, judged, posteriors([v for v, _ in judged])))
        out = Q.judge(spark.createDataFrame(table, "doc_id long, text string")).collect()
        assert collections.Counter((r.doc_id, round(r.p_good, 6), r.base_failed, r.kept) for r in out) == want
    assert len({x[3] for x in want}) == 2


def plain_score(net, text):
    """One text, word by word and window by window."""
    data = (text or "").encode().lower()
    words = re.findall(rb"[0-9a-z\x80-\xff]+", data)
    if not words:
        return 0.0
    p, h = {k: v.astype(np.float64) for k, v in net.p.items()}, T.HIDDEN
    mask = (1 << 64) - 1

    def vector(w):
        x = sum(int(T._LETTER[c]) * pow(int(T._POWER), i, 1 << 64) for i, c in enumerate(w)) & mask
        x = (x ^ x >> 29) * int(T._ODD) & mask
        padded = [0, *w, 0]
        grams = [((padded[i] << 16 | padded[i + 1] << 8 | padded[i + 2]) * int(T._ODD) & mask) >> 44 for i in range(len(w))]
        return np.concatenate([p["word"][(x >> 40) % T.WORD_BUCKETS], np.mean([p["gram"][g % T.TRIGRAM_BUCKETS] for g in grams], axis=0)])

    def run(way, xs):
        state, out = np.zeros(h), []
        for x in xs if way == "f" else xs[::-1]:
            a, s = x @ p[f"W{way}"] + p[f"b{way}"], state @ p[f"U{way}"]
            z, r = (1 / (1 + np.exp(-(a[k * h : k * h + h] + s[k * h : k * h + h]))) for k in (0, 1))
            n = np.tanh(a[2 * h :] + r * (s[2 * h :] + p[f"c{way}"]))
            state = (1 - z) * n + z * state
            out.append(state)
        return out if way == "f" else out[::-1]

    best = -np.inf
    for k in range(1 + max(0, -(-(len(words) - T.WINDOW) // T.STRIDE))):
        xs = [vector(w) for w in words[k * T.STRIDE : k * T.STRIDE + T.WINDOW]]
        states = np.hstack([run("f", xs), run("b", xs)])
        e = np.exp(np.tanh(states @ p["A"] + p["a"]) @ p["v"])
        best = max(best, float((e / e.sum()) @ states @ p["out"] + p["bias"][0]))
    return 1 / (1 + math.exp(-best))


def test_toxicity_scores(spark, rows):
    texts = [r[1] for r in rows] + ["Hello, WORLD hello", "x", "ünï x1 -- é", "a b " * 40, "one\x00two three"]
    labels = [int(bool(t) and i % 3 == 0) for i, t in enumerate(texts)]
    net = T.train([t or "" for t in texts], labels, rounds=2)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.score for r in T.score(docs, net).collect()}
    short = [i for i, t in enumerate(texts) if len(t or "") < 3000]
    assert {i: got[i] for i in short} == {i: pytest.approx(plain_score(net, texts[i]), abs=2e-4) for i in short} and len({round(got[i], 3) for i in short}) > 10

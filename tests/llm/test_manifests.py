"""Exact dedup, fill-in-the-middle and the Merkle manifest against brute force, on the odd cases and on inputs behind a shuffle."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import exact_dedup, fill_middle, merkle


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sha(t):
    return hashlib.sha256(t if isinstance(t, bytes) else t.encode()).hexdigest()


def bag(df, *columns):
    return collections.Counter(tuple(r) for r in df.select(*columns).collect())


@pytest.fixture(scope="session")
def at(docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables") / "documents.parquet")
    docs.write.parquet(path)
    return path


def dedup_reference(rows):
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    out = collections.Counter()
    for t, ids in groups.items():
        order = sorted(ids, key=lambda i: (i is not None, i or 0))
        for n, i in enumerate(order):
            out[(i, order[-1], len(ids), n == len(ids) - 1, sha(t))] += 1
    return out


def digest_columns(df):
    return df.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


@pytest.mark.parametrize("limit", [exact_dedup.BROADCAST_ROWS, 2, 1])
def test_exact_dedup(spark, at, rows, limit):
    out = digest_columns(exact_dedup.decisions(spark, at, limit=limit))
    assert bag(out, *out.columns) == dedup_reference(rows)


def test_exact_dedup_of_texts_that_share_a_digest(spark, at, rows):
    """A digest of one byte: full texts take its groups apart, and the result is the same."""
    weak = lambda text: F.unhex(F.substring(F.sha2(text, 256), 1, 2))
    for limit in (exact_dedup.BROADCAST_ROWS, 2):
        out = exact_dedup.decisions(spark, at, digest=weak, limit=limit)
        assert bag(out, "doc_id", "keep_id", "group_size", "kept") == sum((collections.Counter({k[:4]: v}) for k, v in dedup_reference(rows).items()), collections.Counter())


def test_exact_dedup_goes_on_from_its_state(spark, rows, tmp_path):
    """Several micro-batches, and files that come after the first run: the state has them all, each once."""
    path, state = str(tmp_path / "docs"), str(tmp_path / "state")
    frame = spark.createDataFrame(rows, SCHEMA)
    half = len(rows) // 2
    spark.createDataFrame(rows[:half], SCHEMA).repartition(3).write.parquet(path)
    exact_dedup.decisions(spark, path, state, batch_bytes=1).count()
    assert exact_dedup.retained(spark, state).agg(F.sum("n")).first()[0] == half
    spark.createDataFrame(rows[half:], SCHEMA).repartition(2).write.mode("append").parquet(path)
    out = digest_columns(exact_dedup.decisions(spark, path, state, batch_bytes=1))
    assert bag(out, *out.columns) == dedup_reference(rows)
    assert exact_dedup.retained(spark, state).agg(F.sum("n")).first()[0] == len(rows)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) not in exact_dedup.STATE_STORE.values()
    kept = exact_dedup.keep_one(frame.repartition(2))
    want = collections.Counter({(k[0], k[4]): v for k, v in dedup_reference(rows).items() if k[3]})
    assert bag(kept.withColumn("h", F.sha2(F.coalesce("text", F.lit("")), 256)), "doc_id", "h") == want and kept.columns == frame.columns


def test_exact_dedup_native_and_empty(spark, at, tmp_path):
    out = exact_dedup.decisions(spark, at)
    assert not re.search("Python|Pandas|Arrow", out._jdf.queryExecution().toString())
    none = str(tmp_path / "none")
    spark.read.parquet(at).limit(0).write.parquet(none)
    assert exact_dedup.decisions(spark, none).count() == 0


def draws(i):
    x = sha(f"1:{'' if i is None else i}")
    return [int(x[8 * k : 8 * k + 8], 16) for k in range(4)]


def fim_reference(i, t):
    t = t or ""
    tokens = re.findall("[A-Za-z]+|[^A-Za-z]", t)
    h1, h2, h3, h4 = draws(i)
    a, b = sorted((h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not t or re.search("<[PSM]>", t) or h3 % 100 >= 90:
        return i, len(tokens), "plain", None, None, t, t
    if h4 % 100 < 20:
        return i, len(tokens), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}", t
    return i, len(tokens), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}", t


def test_fill_middle(spark, docs, rows):
    odd = [(900 + i, t) for i, t in enumerate(["a<P>b", "<S", "x<", "<", "S>", "é", "日本 語abc 1\n\n", "a" * 5000, "\U0001f600" * 300 + "z", "A\x00b", " ", "Zz" * 40 + "1"])]
    more = spark.createDataFrame(odd, "doc_id long, text string")
    table = docs.unionByName(more, allowMissingColumns=True)
    want = collections.Counter(fim_reference(i, t) for i, t in [*[(r[0], r[1]) for r in rows], *odd])
    for frame, block in ((table, fill_middle.BLOCK), (table.repartition(2), 50), (table.groupBy("doc_id", "text", "position").agg(F.count(F.lit(1)).alias("k")).where("k > 0").withColumn("k", F.explode(F.expr("sequence(1, k)"))), 700)):
        out = fill_middle.transform(frame, keep=("position",), block=block)
        assert out.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "position"]
        got = bag(out.withColumn("restored", fill_middle.restore(F.col("output"), F.col("form"))), "doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored")
        assert got == want
    assert {k[2] for k in want} == {"plain", "psm", "spm"}


def test_rank_index():
    rng = np.random.default_rng(5)
    for steps in (rng.integers(1, 12, 200_000), np.concatenate([np.ones(5000, int), np.full(5000, 9), [100_000], np.ones(3000, int)]), np.ones(1, int)):
        offsets = np.concatenate([[0], np.cumsum(steps)])
        for error in (4, 127, 1000):
            index = fill_middle.fit(offsets, error, first=64)
            ranks = np.arange(len(offsets))
            assert (abs(index.predict(ranks) - offsets) <= error).all() and (index.find(ranks) == offsets).all()
    few = fill_middle.fit(np.cumsum(rng.integers(1, 12, 200_000)), 127)
    assert len(few.ranks) < 200 and few.residuals.dtype == np.int8


def merkle_reference(rows, tamper):
    """(doc_id, leaf, subroot, root, proof, folded root) of every row, by plain loops."""
    H = lambda *x: sha("".join(x))
    e = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"

    def leaf(r):
        doc_id, text, lang, source, n_chars = r
        return H(*map(e, (doc_id, source, lang, n_chars, text)))

    def build(level):
        out = [level]
        while len(out[-1]) > 1:
            out.append([H(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
        return out

    def way(levels, i):
        for level in levels[:-1]:
            base = i // 8 * 8
            yield i - base, level[base : base + 8]
            i //= 8

    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {g: build([leaf(r) for r in groups[g]]) for g in names}
    top = build([trees[g][-1][0] for g in names])
    out = collections.Counter()
    for k, g in enumerate(names):
        for i, r in enumerate(groups[g]):
            steps = [*way(trees[g], i), *way(top, k)]
            h = leaf(tamper(r))
            for slot, run in steps:
                h = H(*run[:slot], h, *run[slot + 1 :])
            out[(r[0], leaf(r), trees[g][-1][0], top[-1][0], H(*[x for slot, run in steps for j, x in enumerate(run) if j != slot]), h, h == top[-1][0])] += 1
    return out


def lowered(r):
    if r[0] is None or zlib.crc32(str(r[0]).encode()) % 3 or r[1] is None:
        return r
    return (r[0], re.sub("[A-Z]", lambda m: m[0].lower(), r[1]), *r[2:])


def test_merkle(spark, rows, tmp_path):
    rng = random.Random(2)
    many = [(1000 + i, f"Text {i} É" * rng.randint(0, 3), rng.choice(["xx", "en", "é"]), None if i % 7 else "s", i) for i in range(700)]
    many += [(3000, "Alone", "one", "s", 1), (3001, "TWO", "z", "s", 1), (3002, "A", "z", "s", 1)] + [(4000 + i, "Ab", f"l{i}", "s", 1) for i in range(70)]
    for k, table in enumerate(([*rows, *many], rows, many[:1], many[-3:])):
        path = tmp_path / str(k)
        spark.createDataFrame(table, SCHEMA).withColumn("leaf", F.lit("clash")).withColumn("idx", F.lit(1)).repartition(3).write.parquet(str(path / "documents.parquet"))
        out = merkle.query(spark, str(path))
        want = merkle_reference(table, lowered)
        assert bag(out, "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified") == want
    assert {k[6] for k in merkle_reference([*rows, *many], lowered)} == {True, False}


def test_merkle_binary_and_empty(spark, docs):
    out = merkle.manifest(docs.groupBy("doc_id", "lang", "source", "n_chars", "text").agg(F.max("size").alias("size")), arity=2).collect()
    assert len({r.root for r in out}) == 1
    for r in out:
        h = r.leaf
        for s in r.way:
            assert len(s.digests) <= 2 and s.digests[s.slot] == h
            h = sha("".join(s.digests))
        assert h == r.root
    assert merkle.manifest(docs.limit(0)).count() == 0

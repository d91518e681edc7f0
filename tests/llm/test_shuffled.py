"""Every operator gives the same result when its input comes from a shuffle, which may be evaluated in another order each time."""

import collections

import pytest
from pyspark.sql import functions as F

from tidemark.llm import exact_dedup, fill_middle, license_scan, line_dedup, merkle, mixing, quality_rules, secrets, simhash, suffix_dedup, suffix_tree_lm

RUNS = {
    "line_dedup": lambda d: line_dedup.dedup_lines(d), "quality": lambda d: quality_rules.judge(d), "repeated_bytes": lambda d: suffix_dedup.repeated_bytes(d), "suffix_tree": lambda d: suffix_tree_lm.score(d),
    "near_duplicates": lambda d: simhash.near_duplicates(d), "keep_first": lambda d: simhash.keep_first(d).select("doc_id"), "licenses": lambda d: license_scan.licenses(d), "mix": lambda d: mixing.mix(d),
    "secrets": lambda d: secrets.secrets(d), "keep_one": lambda d: exact_dedup.keep_one(d), "fill_middle": lambda d: fill_middle.transform(d), "merkle": lambda d: merkle.manifest(d),
}


def shown(v):
    if isinstance(v, float):
        return round(v, 6)
    return tuple(map(shown, v)) if isinstance(v, (list, tuple)) else bytes(v) if isinstance(v, bytearray) else v


@pytest.mark.parametrize("name", RUNS)
def test_behind_a_shuffle(name, docs):
    columns = docs.columns
    again = docs.repartition(7, F.rand(3)).groupBy(*columns).agg(F.count(F.lit(1)).alias("_n")).select(*columns, F.explode(F.expr("sequence(1, _n)")).alias("_i")).drop("_i")
    bag = lambda df: collections.Counter(str(shown(tuple(r))) for r in df.select(*sorted(df.columns)).collect())
    assert bag(RUNS[name](again)) == bag(RUNS[name](docs))


def test_suffix_tree_behind_a_shuffle(spark):
    """Many documents of many lengths; each has its own score."""
    rows = [(i, f"word{i % 37} " * (1 + i % 11) + f"tail{i}") for i in range(3000)]
    plain = spark.createDataFrame(rows, "doc_id long, text string")
    behind = plain.repartition(16, F.rand(5)).groupBy("doc_id").agg(F.max("text").alias("text"))
    want = {r.doc_id: (round(r.score, 6), r.n_tokens, round(r.base_score, 6)) for r in suffix_tree_lm.score(plain).collect()}
    got = {r.doc_id: (round(r.score, 6), r.n_tokens, round(r.base_score, 6)) for r in suffix_tree_lm.score(behind).collect()}
    assert got == want and len({x[0] for x in want.values()}) > 100

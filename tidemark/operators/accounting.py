"""Every source row has one fate, every target row an origin.

journal: edge, result (produced, excluded, failed), source_key, target_key.
Without a journal the expected frame (source_key, target_key, edge) stands in
for it: `journal_of` makes one of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def journal_of(expected: DataFrame) -> DataFrame:
    """The journal that a derivation implies: each expected row is produced."""
    return expected.select("edge", F.lit("produced").alias("result"), "source_key", "target_key")


def source_facts(sources: DataFrame, journal: DataFrame) -> DataFrame:
    """A row a source: n_produced, n_excluded, n_failed, targets, edges (distinct, in order)."""
    count = lambda r: F.count_if(F.col("result") == r)
    facts = journal.groupBy("source_key").agg(
        count("produced").alias("n_produced"), count("excluded").alias("n_excluded"), count("failed").alias("n_failed"),
        F.array_sort(F.collect_set("target_key")).alias("targets"), F.array_sort(F.collect_set("edge")).alias("edges"),
    )
    none = F.array().cast("array<string>")
    return sources.select("source_key").join(facts, "source_key", "left").select("source_key", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_produced", "n_excluded", "n_failed")], F.coalesce(F.col("targets").cast("array<string>"), none).alias("targets"), F.coalesce("edges", none).alias("edges"))


def accounting_faults(sources: DataFrame, journal: DataFrame) -> DataFrame:
    """Sources without exactly one fate: source_key, code (failed, conflict, unaccounted)."""
    p, x, f = F.col("n_produced") > 0, F.col("n_excluded") > 0, F.col("n_failed") > 0
    code = F.when(p & x | f & (p | x), "conflict").when(f, "failed").when(~p & ~x, "unaccounted")
    return source_facts(sources, journal).select("source_key", code.alias("code")).where("code IS NOT NULL")


def without_origin(targets: DataFrame, sources: DataFrame, journal: DataFrame) -> DataFrame:
    """Observed targets that no journaled source leads to."""
    origin = journal.where("result = 'produced'").join(sources.select("source_key"), "source_key", "left_semi").select("target_key")
    return targets.join(origin, "target_key", "left_anti")


def lineage(sources: DataFrame, journal: DataFrame) -> DataFrame:
    """A row a target: its sources and edges (distinct, in order)."""
    paths = journal.where("result = 'produced'").join(sources.select("source_key"), "source_key", "left_semi")
    return paths.groupBy("target_key").agg(F.array_sort(F.collect_set("source_key")).alias("sources"), F.array_sort(F.collect_set("edge")).alias("edges"))


def dispositions(sources: DataFrame, journal: DataFrame, operations: dict[str, str]) -> DataFrame:
    """A row a source: disposition and targets. operations: each edge's kind (archive, derive, transform, copy ...)."""
    edges = F.col("edges")
    of = lambda kinds: F.lit(False) if not (hit := [e for e, k in operations.items() if k in kinds]) else F.arrays_overlap(edges, F.array(*map(F.lit, hit)))
    made = F.when(of({"archive"}), "archived").when(of({"derive", "aggregate"}), "derived").when(of({"transform", "map", "split"}), "transformed").otherwise("migrated")
    p, x, f = F.col("n_produced") > 0, F.col("n_excluded") > 0, F.col("n_failed") > 0
    kind = F.when(f, "failed").when(p & ~x, made).when(x & ~p, "excluded").otherwise("unaccounted")
    return source_facts(sources, journal).select("source_key", kind.alias("disposition"), "targets")


def coverage(sources: DataFrame, disposed: DataFrame, targets: DataFrame, lined: DataFrame) -> DataFrame:
    """One row of six counts: what dispositions and lineage miss, have too much, or leave open."""
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("what"), "n")
    parts = [
        count(sources.join(disposed, "source_key", "left_anti"), "disposition_missing"),
        count(disposed.join(sources, "source_key", "left_anti"), "disposition_unexpected"),
        count(disposed.where("disposition = 'unaccounted'"), "disposition_unaccounted"),
        count(targets.join(lined, "target_key", "left_anti"), "lineage_missing"),
        count(lined.join(targets, "target_key", "left_anti"), "lineage_unexpected"),
        count(lined.select(F.explode("sources").alias("source_key")).join(sources, "source_key", "left_anti"), "lineage_unbound"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def journal_faults(journal: DataFrame, sources: DataFrame, expected: DataFrame, operations: dict[str, str]) -> DataFrame:
    """Entries that cannot be: edge, source_key, target_key, code (unknown_edge, unknown_result, unknown_source, unknown_target, repeated)."""
    entry = journal.select("edge", "result", "source_key", "target_key")
    legal = F.when(~F.col("edge").isin(*operations), "unknown_edge").when(~F.col("result").isin("produced", "excluded", "failed", "metadata"), "unknown_result")
    keys = ["edge", "source_key", "target_key"]
    parts = [
        entry.select(*keys, legal.alias("code")).where("code IS NOT NULL"),
        entry.join(sources, "source_key", "left_anti").select(*keys, F.lit("unknown_source").alias("code")),
        entry.where("result = 'produced'").join(expected.select("target_key"), "target_key", "left_anti").select(*keys, F.lit("unknown_target").alias("code")),
        entry.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*keys, F.lit("repeated").alias("code")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def journal_scope(journal: DataFrame) -> DataFrame:
    """Distinct sources and targets of each edge."""
    return journal.groupBy("edge").agg(F.countDistinct("source_key").alias("n_sources"), F.countDistinct("target_key").alias("n_targets"))

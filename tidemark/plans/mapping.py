"""Declared mappings from source datasets to the expected target.

An edge is one projection: Catalyst sees a plain select. Rows that a strict
step cannot map (null where the source had a value, or a null identity) go to
the rejects with the failing field; by default any reject fails the run.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import prefixed

OPERATIONS = ("copy", "map", "split", "transform", "archive", "exclude", "relationship")
#: Declared elsewhere, but no projection of one source: they are refused here, not run as a copy.
REFUSED = ("derive", "merge", "aggregate")
Step = Callable[[Column], Column]


@dataclass(frozen=True)
class Edge:
    """source (a dataset, or an earlier target) to targets. fields: target field to (source field, steps); empty: all fields as they are."""

    name: str
    source: str
    targets: tuple[str, ...] = ()
    operation: str = "copy"
    fields: dict[str, tuple[str, tuple[Step, ...]]] = field(default_factory=dict)
    rename: dict[str, str] = field(default_factory=dict)
    every: tuple[Step, ...] = ()
    where: str | None = None

    def __post_init__(self) -> None:
        if self.operation in REFUSED:
            raise ValueError(f"{self.name}: {self.operation} is no projection of one source; prepare its rows (see merge) and copy them")
        if self.operation not in OPERATIONS:
            raise ValueError(f"{self.name}: no operation {self.operation!r}")
        if self.operation == "split" and len(self.targets) < 2:
            raise ValueError(f"{self.name}: a split needs two targets or more")
        if self.operation in ("exclude", "relationship") and self.targets:
            raise ValueError(f"{self.name}: {self.operation} has no target rows")


@dataclass(frozen=True)
class Plan:
    edges: tuple[Edge, ...]
    keys: dict[str, tuple[str, ...]]

    def digest(self) -> str:
        """A hash over fields and steps (as the expressions that they build) that does not depend on the order of edges."""
        steps = lambda x: [re.sub(r"\b([a-z])_\d+\b", r"\1", str(step(F.col("value")))) for step in x]
        fields = lambda e: sorted((k, v[0], steps(v[1])) for k, v in e.fields.items())
        said = sorted(json.dumps([e.name, e.source, e.targets, e.operation, fields(e), sorted(e.rename.items()), steps(e.every), e.where]) for e in self.edges)
        return hashlib.sha256(json.dumps([said, sorted((k, list(v)) for k, v in self.keys.items())]).encode()).hexdigest()


def identity(keys: tuple[str, ...]) -> Column:
    """A row's identity as text; null if a key is."""
    return prefixed(*[F.col(k) for k in keys])


def apply_edge(df: DataFrame, edge: Edge) -> DataFrame:
    """The edge's projection: target fields, and `_bad`, the first field that had a value and lost it."""
    chosen = df.where(edge.where) if edge.where else df
    wanted = edge.fields or {c: (c, ()) for c in df.columns}
    if lost := [s for s, _ in wanted.values() if s not in df.columns] + [k for k in edge.rename if k not in wanted]:
        raise ValueError(f"{edge.name}: no such field: {', '.join(lost)}")
    out, bad = [], []
    for name, (source, steps) in wanted.items():
        value = reduce(lambda c, step: step(c), (*steps, *edge.every), F.col(source))
        out.append(value.alias(edge.rename.get(name, name)))
        if steps or edge.every:
            bad.append(F.when(value.isNull() & F.col(source).isNotNull(), F.lit(name)))
    return chosen.select("*", F.coalesce(*bad, F.lit(None).cast("string")).alias("_bad")).select(*out, "_bad") if bad else chosen.select(*out, F.lit(None).cast("string").alias("_bad"))


def expected_state(plan: Plan, datasets: dict[str, DataFrame], on_reject: str = "fail") -> tuple[dict[str, DataFrame], DataFrame, DataFrame]:
    """(expected frame of each target with _source_key, _target_key and _edge; rejects; journal).

    Targets of earlier edges may be sources of later ones. on_reject: "fail" makes reading an expected
    frame raise on a row that cannot be mapped, "keep" leaves such rows to the rejects.
    """
    known, made, rejects, journal = dict(datasets), {}, [], []
    for e in plan.edges:
        if e.operation == "relationship":
            spark = next(iter(datasets.values())).sparkSession
            journal.append(spark.range(1).select(F.lit(e.name).alias("edge"), F.lit("metadata").alias("result"), F.lit(None).cast("string").alias("source_key"), F.lit(None).cast("string").alias("target_key")))
            continue
        df = known[e.source]
        source_key = identity(plan.keys[e.source]).alias("_source_key")
        if e.operation == "exclude":
            journal.append((df.where(e.where) if e.where else df).select(F.lit(e.name).alias("edge"), F.lit("excluded").alias("result"), source_key.alias("source_key"), F.lit(None).cast("string").alias("target_key")))
            continue
        for target in e.targets:
            fields = dict(e.fields or {c: (c, ()) for c in df.columns})
            projected = apply_edge(df.withColumn("_source_key", source_key), Edge(e.name, e.source, e.targets, e.operation, {**fields, "_source_key": ("_source_key", ())}, e.rename, e.every, e.where))
            keyed = projected.withColumn("_target_key", identity(plan.keys[target])).withColumn("_edge", F.lit(e.name))
            bad = F.coalesce("_bad", F.when(F.col("_target_key").isNull(), F.lit("identity")))
            rejects.append(keyed.where(bad.isNotNull()).select("_edge", "_source_key", bad.alias("field")))
            if on_reject == "fail":
                # a filter, so that it holds whichever columns are read, or none
                good = keyed.where(F.when(bad.isNull(), True).otherwise(F.raise_error(F.concat(F.lit(f"{e.name}: cannot map "), bad)).cast("boolean")))
            else:
                good = keyed.where(bad.isNull())
            good = good.drop("_bad")
            made[target] = made[target].unionByName(good) if target in made else good
            known[target] = made[target].drop("_source_key", "_target_key", "_edge")
            journal.append(good.select(F.col("_edge").alias("edge"), F.lit("produced").alias("result"), F.col("_source_key").alias("source_key"), F.col("_target_key").alias("target_key")))
            if on_reject == "keep":
                journal.append(keyed.where(bad.isNotNull()).select(F.col("_edge").alias("edge"), F.lit("failed").alias("result"), F.col("_source_key").alias("source_key"), F.lit(None).cast("string").alias("target_key")))
    union = lambda parts: reduce(DataFrame.unionByName, parts) if parts else None
    return made, union(rejects), union(journal)


def lookup(df: DataFrame, table: DataFrame, on: str, key: str, value: str, alias: str) -> DataFrame:
    """df with a looked-up field; Spark broadcasts the table where its size allows."""
    return df.join(table.select(F.col(key).alias("_k"), F.col(value).alias(alias)), F.col(on) == F.col("_k"), "left").drop("_k")


def merge(left: DataFrame, right: DataFrame, keys: list[str], how: str = "full_outer") -> DataFrame:
    """Two sources to one target, by key."""
    return left.join(right, keys, how)

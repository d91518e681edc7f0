"""Mixing sources to target weights with a time-varying curriculum (DataFrame operations only).

Each source's schedule is a weight density over training time 0..1. Its
integral is the source's share of all words; a target stops at ``cap`` times
what the source has, and the excess is shared again by weight. A source's
demand is met by going through its documents in a fixed pseudo-random order,
again from the start when they run out, and cutting the last document where
the demand ends. The cumulative demand at a document is then inverted through
the integrated schedule to give the document's position in training.

Running sums are taken in two levels (sums of buckets of the order, then
within a bucket), so no source is gathered in one task however large it is.

Defined results: a null text has size 0; a null source is a source of its own
and comes last; a source without words has target 0; null or repeated
document ids are ordinary rows; an empty table gives an empty result; extra
columns are not looked at.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut, words_of

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (1, 2, 3)
#: Most times a source may be gone through.
CAP = 3
#: For each weight its density at the start and the end of training, linear between; the mean is 1,
#: so that the integral over training is the weight itself.
RAMPS = {1: (1.5, 0.5), 2: (1.0, 1.0), 3: (0.5, 1.5)}


def source_targets(sizes: DataFrame, weights=WEIGHTS, cap: float = CAP) -> DataFrame:
    """One row a source: source, weight, source_size, target.

    ``sizes`` has source and source_size, a row a source. With sources in the order of cap / weight,
    those that reach their cap are a prefix: a source does if its cap lies below its share of what
    the sources before it leave.
    """
    named = Window.orderBy(F.col("source").asc_nulls_last())
    scarce = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, after = scarce.rowsBetween(Window.unboundedPreceding, -1), scarce.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), ((F.row_number().over(named) - 1) % len(weights) + 1).cast("int")))
    left = (
        ranked.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("level", (F.col("total") - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("weight").over(after))
        .withColumn("full", cap * F.col("source_size") <= F.col("weight") * F.col("level"))
    )
    level = F.min(F.when(~F.col("full"), F.struct(F.col("source_size") / F.col("weight"), F.col("level")))).over(everything)["level"]
    return left.withColumn("open_level", level).select(
        "source", "weight", "source_size", F.when(F.col("full"), F.lit(float(cap)) * F.col("source_size")).otherwise(F.col("weight") * F.col("open_level")).cast("double").alias("target")
    )


def invert_ramp(share: Column, weight: Column, ramps=RAMPS) -> Column:
    """The time at which a source's integrated schedule reaches a share of its demand."""
    out = share
    for w, (a, b) in ramps.items():
        if a != b:
            out = F.when(weight == w, (F.lit(-a) + F.sqrt(F.lit(a * a) + F.lit(2 * (b - a) * (a + b) / 2) * share)) / (b - a)).otherwise(out)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), out))


def mix(docs: DataFrame, weights=WEIGHTS, cap: float = CAP, ramps=RAMPS, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row a document: doc_id, source, size, source_size, target, taken, positions, position, and the columns in keep (but for those of these names).

    positions: when in training (0 to 1) each copy comes, to nine digits; position: the first of them, null if nothing is taken.
    """
    text = F.col("text")
    order = F.md5(F.col("doc_id").cast("string").cast("binary"))
    kept = [c for c in keep if c not in ("doc_id", "source", "size", "source_size", "target", "taken", "positions", "position")]
    sized = cut(docs.select("doc_id", "source", F.struct(*kept).alias("kept") if kept else F.lit(None).cast("string").alias("kept"), F.size(words_of(text)).cast("long").alias("size"), F.coalesce(order, F.lit("")).alias("order_key")))
    n_buckets = 1 + isqrt(sized.count())  # so that neither a bucket nor the list of buckets gets long
    # the order key's first 32 bits, spread over the buckets in its own order
    sized = sized.withColumn("bucket", F.floor(F.coalesce(F.conv(F.substring("order_key", 1, 8), 16, 10).cast("long"), F.lit(0)) * F.lit(n_buckets) / F.lit(2.0**32)).cast("long"))
    buckets = sized.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    sources = source_targets(buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, cap)
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = buckets.select("source", "bucket", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)).alias("offset"))
    within = Window.partitionBy("source", "bucket").orderBy("order_key", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0))).alias("d")
    o, s = offsets.alias("o"), sources.alias("s")
    joined = placed.join(o, F.col("d.source").eqNullSafe(F.col("o.source")) & (F.col("d.bucket") == F.col("o.bucket"))).join(s, F.col("d.source").eqNullSafe(F.col("s.source")))
    whole = F.col("source_size") > 0
    quota = F.floor("target").cast("long")
    rounds = F.when(whole, F.expr("floor(target) div source_size")).otherwise(0).cast("long")
    rest = quota - F.col("rounds") * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before"))).cast("long")
    share = lambda e: (e * F.col("source_size") + F.col("before") + F.when(e < F.col("rounds"), F.col("size")).otherwise(F.col("part")) / 2) / F.floor("target")
    return (
        joined.select("d.doc_id", "d.source", "d.kept", "d.size", "s.weight", "s.source_size", "s.target", (F.col("inside") + F.col("offset")).alias("before"))
        .withColumn("rounds", rounds)
        .withColumn("part", F.when(whole, part).otherwise(0).cast("long"))
        .withColumn("copies", (F.when(F.col("size") > 0, F.col("rounds")).otherwise(0) + (F.col("part") > 0).cast("int")).cast("int"))
        .withColumn("positions", F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0), F.col("copies") - 1), lambda e: F.round(invert_ramp(share(e), F.col("weight"), ramps), 9))).otherwise(F.array().cast("array<double>")))
        .select("doc_id", "source", *[f"kept.`{c}`" for c in kept], "size", "source_size", "target", (F.col("rounds") * F.col("size") + F.col("part")).cast("long").alias("taken"), "positions", F.get("positions", F.lit(0)).alias("position"))
    )


def training_order(mixed: DataFrame) -> DataFrame:
    """The mix as training reads it: one row a copy, range-sorted by position."""
    return mixed.withColumn("position", F.explode("positions")).drop("positions").orderBy("position", "doc_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: the digest of the mix of all documents, range-sorted by first position."""
    mixed = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "position").orderBy(F.col("position").asc_nulls_last(), "doc_id")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, coalesce(md5(CAST(doc_id AS VARCHAR)), '') AS k
  FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS INTEGER) AS weight, CAST(sum(source_size) OVER () AS BIGINT) AS total FROM s0),
s2 AS (
  SELECT *, CAST(total - 3 * coalesce(sum(source_size) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
    / CAST(sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM s1),
s3 AS (SELECT *, 3 * source_size <= weight * level AS filled FROM s2),
s4 AS (
  SELECT source, weight, source_size,
    CASE WHEN filled THEN 3.0 * source_size ELSE weight * (SELECT arg_min(level, source_size / weight) FROM s3 WHERE NOT filled) END::DOUBLE AS target
  FROM s3),
p AS (
  SELECT d.doc_id, d.size, s4.weight, s4.source_size, s4.target,
    CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY k, d.doc_id NULLS FIRST, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM d JOIN s4 ON d.source IS NOT DISTINCT FROM s4.source),
q AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS rounds FROM p),
r AS (SELECT *, CASE WHEN source_size > 0 THEN greatest(0, least(size, CAST(floor(target) AS BIGINT) - rounds * source_size - before)) ELSE 0 END AS part FROM q),
t AS (SELECT *, CASE WHEN size > 0 AND rounds + CAST(part > 0 AS INTEGER) > 0 THEN (before + CASE WHEN rounds > 0 THEN size ELSE part END / 2) / floor(target) END AS share FROM r)
SELECT doc_id, size, source_size, target, CAST(rounds * size + part AS BIGINT) AS taken,
  CASE WHEN share IS NOT NULL THEN round(least(1.0, greatest(0.0, CASE weight WHEN 1 THEN (-1.5 + sqrt(2.25 - 2 * share)) / -1.0 WHEN 3 THEN (-0.5 + sqrt(0.25 + 2 * share)) / 1.0 ELSE share END)), 9) END AS position
FROM t
"""

"""Findings of a run, and runs against each other."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.canonical import LANES, row_fingerprint
from tidemark.functions.columns import digest, percentage
from tidemark.schema import FAILING


def _numbered(df: DataFrame, keys: list[str], order: str, prefix: int = 4) -> DataFrame:
    """df with rn, the number of a row of its keys in the order of a text column.

    Rows are counted by the text's first characters, which keep its order, and numbered within them,
    so that a group of any size spreads over tasks.
    """
    cut = df.withColumn("_part", F.substring(order, 1, prefix))
    parts = [*keys, "_part"]
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = cut.groupBy(*parts).agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select(*[F.col(c).alias(f"_{c}") for c in parts], F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    within = cut.withColumn("rn", F.row_number().over(Window.partitionBy(*parts).orderBy(order)))
    same = F.lit(True)
    for c in parts:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return within.join(offsets, same).select(*df.columns, (F.col("rn") + F.col("_before")).alias("rn"))


def run_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Finding changes between two runs: check_id, dataset, stable_key, change (persisting, changed, resolved, added).

    Three passes: equal findings are matched as a bag; what is left of the same check, code and dataset
    is paired in the order of the stable keys as changed; the rest was resolved or added.
    """
    exact = ["check_id", "code", "dataset", "stable_key"]
    number = lambda df, keys, order: df.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    b, a = number(before.select(*exact), exact, ["stable_key"]), number(after.select(*exact), exact, ["stable_key"])
    same = [*exact, "rn"]
    kept = b.join(a, same, "left_semi").select(*exact, F.lit("persisting").alias("change"))
    loose = ["check_id", "code", "dataset"]
    left = _numbered(b.join(a, same, "left_anti").drop("rn"), loose, "stable_key").withColumnRenamed("stable_key", "was")
    new = _numbered(a.join(b, same, "left_anti").drop("rn"), loose, "stable_key")
    rest = left.join(new, [*loose, "rn"], "full_outer")
    change = F.when(F.col("was").isNull(), "added").when(F.col("stable_key").isNull(), "resolved").otherwise("changed")
    return kept.unionByName(rest.select(*loose, F.coalesce("stable_key", "was").alias("stable_key"), change.alias("change")))


def input_buckets(df: DataFrame, keys: list[str], columns: list[str] | None = None, digits: int = 2) -> DataFrame:
    """The fingerprint of a run's input in pieces: bucket (the first digits of its key's digest), n, and the digest of its rows as a bag. Sums, combined before they are sent."""
    hashed = df.select(F.substring(digest(*[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]), 1, digits).alias("bucket"), row_fingerprint(df, columns).alias("h"))
    lanes = [F.sum(F.conv(F.substring("h", 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)")).cast("decimal(38,0)").alias(f"lane{i}") for i in range(LANES)]
    return hashed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), *lanes).select("bucket", "n", F.concat_ws(":", *[f"lane{i}" for i in range(LANES)]).alias("digest"))


def changed_inputs(before: dict[str, DataFrame], after: dict[str, DataFrame]) -> DataFrame:
    """Where the inputs of two runs (input_buckets by dataset) differ: dataset, bucket, n_before, n_after, change (added, removed, changed)."""
    side = lambda run, s: reduce(DataFrame.unionByName, [b.select(F.lit(name).alias("dataset"), "bucket", F.col("n").alias(f"n_{s}"), F.col("digest").alias(f"_{s}")) for name, b in run.items()])
    both = side(before, "before").join(side(after, "after"), ["dataset", "bucket"], "full_outer").where(~F.col("_before").eqNullSafe(F.col("_after")))
    change = F.when(F.col("_before").isNull(), "added").when(F.col("_after").isNull(), "removed").otherwise("changed")
    return both.select("dataset", "bucket", F.coalesce("n_before", F.lit(0)).alias("n_before"), F.coalesce("n_after", F.lit(0)).alias("n_after"), change.alias("change"))


def delta_summary(delta: DataFrame) -> DataFrame:
    """One row: n_persisting, n_changed, n_resolved, n_added, equivalent."""
    kinds = ("persisting", "changed", "resolved", "added")
    out = delta.agg(*[F.count_if(F.col("change") == k).alias(f"n_{k}") for k in kinds])
    return out.withColumn("equivalent", F.expr("n_changed + n_resolved + n_added = 0"))


def baseline_class(summary: DataFrame, baseline_qualified: bool, candidate_qualified: bool, comparable: bool = True) -> DataFrame:
    """The summary with class: not_comparable, equivalent, improved, regressed, changed_still_qualified, still_not_qualified."""
    q0, q1 = F.lit(baseline_qualified), F.lit(candidate_qualified)
    kind = F.when(~F.lit(comparable), "not_comparable").when(F.col("equivalent") & (q0 == q1), "equivalent").when(~q0 & q1, "improved").when(q0 & ~q1, "regressed").when(q1, "changed_still_qualified").otherwise("still_not_qualified")
    return summary.withColumn("class", kind)


def group_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Failed findings by check and code in two runs, with n_resolved and n_introduced."""
    count = lambda df, n: df.where("result = 'fail'").groupBy("check_id", "code").agg(F.count(F.lit(1)).alias(n))
    both = count(before, "n_before").join(count(after, "n_after"), ["check_id", "code"], "full_outer").na.fill(0, ["n_before", "n_after"])
    return both.select("check_id", "code", "n_before", "n_after", F.greatest(F.col("n_before") - F.col("n_after"), F.lit(0)).alias("n_resolved"), F.greatest(F.col("n_after") - F.col("n_before"), F.lit(0)).alias("n_introduced"))


def annotate(findings: DataFrame, expected: DataFrame) -> DataFrame:
    """Findings with expected_reason, null if no annotation (check_id, code, dataset, reason) fits. Findings are marked, never removed."""
    notes = expected.groupBy("check_id", "code", "dataset").agg(F.min("reason").alias("expected_reason"))
    failed = F.col("result") == "fail"
    return findings.join(notes, ["check_id", "code", "dataset"], "left").withColumn("expected_reason", F.when(failed, F.col("expected_reason")))


def unmatched_annotations(findings: DataFrame, expected: DataFrame) -> DataFrame:
    """Annotations that no failed finding fits."""
    return expected.join(findings.where("result = 'fail'"), ["check_id", "code", "dataset"], "left_anti")


def by_check(findings: DataFrame) -> DataFrame:
    return findings.groupBy("check_id", "code").agg(F.count(F.lit(1)).alias("n"))


def scorecard(findings: DataFrame, sections: DataFrame) -> DataFrame:
    """Counts by section: n_pass, n_fail, n_warning. sections: code, section; a code may be in several."""
    count = lambda r: F.count_if(F.col("result") == r)
    return findings.join(sections, "code").groupBy("section").agg(count("pass").alias("n_pass"), count("fail").alias("n_fail"), count("warning").alias("n_warning"))


def discrepancies(findings: DataFrame, categories: DataFrame | None = None) -> DataFrame:
    """Failed findings by category (codes without one are left out), or all of them as one."""
    failed = findings.where("result = 'fail'")
    named = failed.join(categories.select("code", "category").distinct(), "code") if categories is not None else failed.withColumn("category", F.lit("all"))
    return named.groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def outcome(findings: DataFrame) -> DataFrame:
    """One row: n_failed_checks, n_warning_checks, outcome. Checks count once; only failing severities fail."""
    failed = F.when((F.col("result") == "fail") & F.col("severity").isin(*FAILING), F.col("check_id"))
    warned = F.when((F.col("result") == "warning") | (F.col("result") == "fail") & ~F.col("severity").isin(*FAILING), F.col("check_id"))
    out = findings.agg(F.countDistinct(failed).alias("n_failed_checks"), F.countDistinct(warned).alias("n_warning_checks"))
    return out.withColumn("outcome", F.when(F.col("n_failed_checks") > 0, "failed").when(F.col("n_warning_checks") > 0, "passed_with_warnings").otherwise("passed"))


def qualification(outcomes: DataFrame, state_unchanged: bool, recovery_passed: bool) -> DataFrame:
    """Qualified only if the checks passed, the state is unchanged and recovery passed."""
    return outcomes.withColumn("qualified", (F.col("outcome") == "passed") & F.lit(state_unchanged) & F.lit(recovery_passed))


def run_history(runs: DataFrame) -> DataFrame:
    """Newest run first; a run without a start stays, last, and is marked invalid."""
    return runs.withColumn("valid", F.col("started_at").isNotNull()).orderBy(F.col("started_at").desc_nulls_last(), "run_id")


def evidence(findings: DataFrame) -> DataFrame:
    """Findings with evidence_id, a digest of run, check and stable key."""
    return findings.withColumn("evidence_id", F.sha2(F.concat_ws("\x1f", "run_id", "check_id", "stable_key"), 256))


def repeated_evidence(findings: DataFrame) -> DataFrame:
    return evidence(findings).groupBy("evidence_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def recovery_coverage(lineage: DataFrame, assessments: DataFrame) -> DataFrame:
    """By semantic_type: n_affected, n_recoverable, n_irrecoverable, n_unknown, percent. Every edge of a target's path must be recoverable; lineage: target_key, semantic_type, edges; assessments: edge, recoverable (null: unknown)."""
    steps = lineage.select("target_key", "semantic_type", F.explode("edges").alias("edge")).join(assessments, "edge", "left")
    per = steps.groupBy("target_key", "semantic_type").agg(F.bool_and(F.coalesce("recoverable", F.lit(False))).alias("all_"), F.bool_or(~F.col("recoverable")).alias("lost"))
    state = F.when(F.col("all_"), "recoverable").when(F.coalesce("lost", F.lit(False)), "irrecoverable").otherwise("unknown")
    counts = per.withColumn("state", state).groupBy("semantic_type").agg(F.count(F.lit(1)).alias("n_affected"), *[F.count_if(F.col("state") == s).alias(f"n_{s}") for s in ("recoverable", "irrecoverable", "unknown")])
    return counts.withColumn("percent", percentage(F.col("n_recoverable"), F.col("n_affected")))


def irreversible(df: DataFrame, source_fields: list[str], target_fields: list[str]) -> DataFrame:
    """Target values that several source values map to, with n: where a mapping is not one-to-one on the data."""
    return df.select(F.struct(*source_fields).alias("_s"), *target_fields).distinct().groupBy(*target_fields).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def restored_differences(baseline: DataFrame, restored: DataFrame) -> DataFrame:
    """Rows that a restore lost or added, as bags, with side."""
    restored = restored.select(*baseline.columns)
    return baseline.exceptAll(restored).withColumn("side", F.lit("lost")).unionByName(restored.exceptAll(baseline).withColumn("side", F.lit("added")))


def report(findings: DataFrame, coverage: DataFrame) -> DataFrame:
    """What a run comes to, as rows (section, item, n): findings by result and by check and code, and the gaps in accounting and lineage."""
    rows = [
        findings.groupBy(F.col("result").alias("item")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("result").alias("section"), "item", "n"),
        by_check(findings.where("result = 'fail'")).select(F.lit("failed").alias("section"), F.concat_ws("/", "check_id", "code").alias("item"), "n"),
        coverage.select(F.lit("coverage").alias("section"), F.col("what").alias("item"), "n"),
    ]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def dangling_evidence(findings: DataFrame, references: DataFrame) -> DataFrame:
    """References (from_id, to_id) to evidence that is not there."""
    return references.join(evidence(findings).select(F.col("evidence_id").alias("to_id")), "to_id", "left_anti")

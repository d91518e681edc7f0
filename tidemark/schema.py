"""Fixed shapes of the frames that the library hands out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FINDING = "run_id string, check_id string, check_type string, scope string, result string, severity string, code string, stable_key string, dataset string, expected string, actual string, detail string"
JOURNAL = "run_id string, edge string, result string, source string, source_key string, target string, target_key string, reason string"
DISPOSITION = "run_id string, source string, source_key string, disposition string, targets array<string>, reason string"
LINEAGE = "run_id string, target string, target_key string, sources array<string>, edges array<string>, basis string"
CAPTURE = "capture_id string, dataset string, n_rows long, n_bytes long, fingerprint string, scope_id string, consistency string, started_at timestamp, completed_at timestamp"
PROFILE = "dataset string, field string, type string, nullable boolean, ordinal int, n_rows long, n_null long, n_empty long"

#: Severities that make a run fail.
FAILING = ("critical", "error")


def as_findings(rows: DataFrame, *, check_id: str | Column, check_type: str | Column, code: str | Column, key: str | Column, dataset: str | Column, expected: Column | None = None, actual: Column | None = None, detail: Column | None = None, result: str | Column = "fail", severity: str | Column = "error", run_id: str = "", scope: str | Column = "full") -> DataFrame:
    """Rows as findings. key: what names the finding; its stable key is a hash of the check and it."""
    text = lambda c: F.lit(None).cast("string") if c is None else c.cast("string")
    col = lambda c: F.lit(c) if isinstance(c, str) else c
    name = F.col(key) if isinstance(key, str) else key
    return rows.select(
        F.lit(run_id).alias("run_id"), col(check_id).alias("check_id"), col(check_type).alias("check_type"), col(scope).alias("scope"),
        col(result).alias("result"), col(severity).alias("severity"), col(code).alias("code"),
        F.sha2(F.concat_ws("\x1f", col(check_id), col(code), F.coalesce(name.cast("string"), F.lit(""))), 256).alias("stable_key"),
        col(dataset).alias("dataset"), text(expected).alias("expected"), text(actual).alias("actual"), text(detail).alias("detail"),
    )

"""Several checks of one dataset and key in one pass over both sides.

Presence, no_unexpected, values, uniqueness and total all ask what either side
has for a key. Both sides go through one exchange into one aggregate a key; its
rows give the findings of all these checks, and what is summed up on the way
(observed while the findings are written) gives the totals and tells which
checks found nothing. Keys whose rows must be told apart one by one (an
expected key twice, a surplus key twice, a key with a null on both sides) are
left to the checks' own definitions, on those keys alone.
"""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.columns import as_decimal, code_map, prefixed
from tidemark.shared import observed

#: Kinds that are answered together; total joins them if its dataset has one of the others.
BY_KEY = ("presence", "no_unexpected", "values", "uniqueness")
_EMPTY = "array<struct<check:int,code:string,key:string,expected:string,actual:string,detail:string>>"


def plan_groups(checks: list, expected: dict[str, DataFrame]) -> list[list[int]]:
    """Positions of the checks that are answered together, a list a dataset, key and part; checks in none of them stand alone."""
    part = lambda c: c.only.digest() if c.only else ""

    def simple(options: dict) -> bool:
        kinds = {f.name: f.dataType for f in expected[options["dataset"]].schema.fields}
        return not any(isinstance(kinds.get(f), (T.MapType, T.VariantType)) for f in options.get("fields", ()))

    groups: dict[tuple, list[int]] = {}
    for i, c in enumerate(checks):
        if c.kind in BY_KEY and simple(c.options):
            groups.setdefault((c.options["dataset"], part(c), tuple(c.options["keys"])), []).append(i)
    for i, c in enumerate(checks):
        if c.kind == "total" and (home := next((g for k, g in groups.items() if k[:2] == (c.options["dataset"], part(c))), None)):
            home.append(i)
    return [g for g in groups.values() if len(g) > 1]


def _side(df: DataFrame, keys: list[str], is_expected: bool, checks: dict[int, object]) -> DataFrame:
    columns = [F.col(k) for k in keys]
    for i, c in checks.items():
        if c.kind == "values":
            maps = c.options.get("maps") or {} if is_expected else {}
            columns.append(F.struct(*[(code_map(F.col(f), maps[f]) if f in maps else F.col(f)).alias(f) for f in c.options["fields"]]).alias(f"_v{i}"))
        elif c.kind == "total":
            columns += [as_decimal(F.col(c.options["measure"]), c.options.get("scale", 2)).alias(f"_m{i}"), F.col(c.options["key"]).alias(f"_k{i}")]
    return df.select(*columns, F.lit(is_expected).alias("_expected"))


def _per_key(sides: DataFrame, keys: list[str], checks: dict[int, object]) -> DataFrame:
    is_e = F.col("_expected")
    of = {"e": is_e, "a": ~is_e}
    sums = [F.count_if(w).alias(f"n_{s}") for s, w in of.items()]
    for i, c in checks.items():
        for s, w in of.items():
            if c.kind == "values":
                sums.append(F.min(F.when(w, F.col(f"_v{i}"))).alias(f"{s}{i}"))
            elif c.kind == "total":
                sums += [F.try_sum(F.when(w, F.col(f"_m{i}"))).alias(f"total_{s}{i}"), F.count(F.when(w, F.col(f"_m{i}"))).alias(f"valid_{s}{i}")]
    return sides.groupBy(*keys).agg(*sums)


def _findings(keys: list[str], checks: dict[int, object]) -> tuple[Column, Column]:
    """(whether a key's rows must be told apart, the findings of the others)."""
    no_key = reduce(lambda x, k: x | F.col(k).isNull(), keys, F.lit(False))
    key = prefixed(*[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])
    n_e, n_a = F.col("n_e"), F.col("n_a")
    unmet_e, unmet_a, met = (n_e > 0) & ((n_a == 0) | no_key), (n_a > 0) & ((n_e == 0) | no_key), (n_e > 0) & (n_a == 1) & ~no_key
    kinds = {c.kind for c in checks.values()}
    apart = F.lit(False)
    if "presence" in kinds:
        apart = apart | unmet_e & (n_e > 1)
    if "no_unexpected" in kinds:
        apart = apart | unmet_a & (n_a > 1)
    if "values" in kinds:
        apart = apart | met & (n_e > 1)
    none = F.lit(None).cast("string")

    def one(when: Column, i: int, code: str, named: Column = key, expected: Column = none, actual: Column = none, detail: Column = none) -> Column:
        return F.when(when, F.struct(F.lit(i).alias("check"), F.lit(code).alias("code"), named.alias("key"), expected.alias("expected"), actual.alias("actual"), detail.alias("detail")))

    found = []
    for i, c in checks.items():
        if c.kind == "presence":
            found.append(one(unmet_e & ~apart, i, "missing"))
        elif c.kind == "no_unexpected":
            found.append(one(unmet_a & ~apart, i, "unexpected"))
        elif c.kind == "uniqueness":
            found.append(one(n_a > 1, i, "repeated", actual=n_a.cast("string")))
        elif c.kind == "values":
            for f in c.options["fields"]:
                e, a = F.col(f"e{i}.{f}"), F.col(f"a{i}.{f}")
                found.append(one(met & ~apart & ~e.eqNullSafe(a), i, "value", F.concat_ws("/", key, F.lit(f)), e.cast("string"), a.cast("string"), F.lit(f)))
    return apart, F.array_compact(F.array(*found)).cast(_EMPTY) if found else F.array().cast(_EMPTY)


def _total_row(c: object, i: int, seen: dict) -> tuple | None:
    """(key, code, expected, actual) if the totals differ, or either has invalid values or is too large."""
    scale, sides, fine = c.options.get("scale", 2), [], True
    for s in "ea":
        n_rows, n_valid, lost, total = seen["n_rows_" + s], seen[f"valid_{s}{i}"] or 0, seen[f"lost_{s}{i}"], seen[f"total_{s}{i}"]
        over = bool(n_valid) and (lost or total is None)
        sides.append(None if over else total if n_valid else Decimal(0))
        fine = fine and not over and n_valid == (n_rows or 0)
    if fine and sides[0] == sides[1]:
        return None
    return (c.options["measure"], "total", *[None if x is None else f"{x:.{scale}f}" for x in sides])


def answer(expected: DataFrame, actual: DataFrame, checks: dict[int, object]) -> tuple[DataFrame, dict[int, int], DataFrame | None, list[tuple]]:
    """(findings: check, code, key, expected, actual, detail; how many each check has; keys to be told apart, if any; findings that are no key's, as tuples).

    checks: by position. Writes the findings; both sides are read once.
    """
    first = next(c for c in checks.values() if c.kind in BY_KEY)
    keys = list(first.options["keys"])
    for c in checks.values():
        for f in c.options.get("fields", ()) if c.kind == "values" else ():
            if f not in actual.columns or expected.schema[f].dataType != actual.schema[f].dataType:
                raise TypeError(f"field {f!r} differs in kind between the sides")
    per_key = _per_key(_side(expected, keys, True, checks).unionByName(_side(actual, keys, False, checks)), keys, checks)
    apart, found = _findings(keys, checks)
    judged = per_key.withColumns({"_apart": apart, "_found": found})
    measures = {"n_rows_e": F.sum("n_e"), "n_rows_a": F.sum("n_a"), "n_apart": F.count_if("_apart")}
    for i, c in checks.items():
        measures[f"found{i}"] = F.sum(F.size(F.filter("_found", lambda x: x["check"] == i)))  # noqa: B023
        if c.kind == "total":
            for s in "ea":
                total, valid = F.col(f"total_{s}{i}"), F.col(f"valid_{s}{i}")
                measures |= {f"total_{s}{i}": F.try_sum(total), f"valid_{s}{i}": F.sum(valid), f"lost_{s}{i}": F.count_if(total.isNull() & (valid > 0))}
    kept, seen = observed(judged, measures, "_apart OR size(_found) > 0")
    counts, extra = {i: seen[f"found{i}"] or 0 for i in checks}, []
    for i, c in checks.items():
        if c.kind == "presence" and not seen["n_rows_e"]:
            extra.append((i, "nothing_expected", "", None, None, None))
        if c.kind == "total" and (row := _total_row(c, i, seen)):
            extra.append((i, row[1], row[0], row[2], row[3], None))
    for x in extra:
        counts[x[0]] += 1
    findings = kept.select(F.explode("_found").alias("x")).select("x.*")
    return findings, counts, kept.where("_apart").select(*keys) if seen["n_apart"] else None, extra

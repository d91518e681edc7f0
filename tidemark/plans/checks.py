"""Checks as functions from two sets of frames to findings, their registry, domain packs, and the run over all of them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import code_map, has_offset, net_holds, prefixed, redacted, same_digest
from tidemark.operators import accounting, reconcile, timelines, totals
from tidemark.plans import fused
from tidemark.plans.scope import Scope
from tidemark.schema import FINDING, as_findings
from tidemark.shared import observed

CHECKS: dict[str, Callable[..., DataFrame]] = {}


@dataclass(frozen=True)
class Context:
    """Frames by dataset. journal and sources: where rows are accounted for (source_key, target_key)."""

    expected: dict[str, DataFrame]
    actual: dict[str, DataFrame]
    sources: DataFrame | None = None
    targets: DataFrame | None = None
    journal: DataFrame | None = None
    run_id: str = ""
    scope: str = "full"
    redact: bool = False  # digests in place of values in the findings


@dataclass(frozen=True)
class Check:
    """One use of a registered check.

    only: the part of its dataset, on both sides, that it is about; findings carry its name. Its predicates are
    on fields that both sides share, such as keys and types: a row that is in it on one side alone is missing on the other.
    """

    check_id: str
    kind: str
    options: dict = field(default_factory=dict)
    severity: str = "error"
    only: Scope | None = None


def check(name: str):
    def register(f):
        if name in CHECKS:
            raise ValueError(f"check {name!r} is registered twice")
        CHECKS[name] = f
        return f

    return register


def _key(keys: list[str]) -> Column:
    return prefixed(*[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])



def _mapped(df: DataFrame, maps: dict[str, dict[str, str]] | None) -> DataFrame:
    """df with the codes of some fields replaced; a code that has no entry is expected as null."""
    return df.withColumns({f: code_map(F.col(f), codes) for f, codes in (maps or {}).items()})


@check("presence")
def presence(ctx: Context, dataset: str, keys: list[str]) -> DataFrame:
    """Expected rows are there. An empty expectation is a fault of its own."""
    e = ctx.expected[dataset]
    gone = reconcile.missing(e, ctx.actual[dataset], keys).select(_key(keys).alias("key"), F.lit("missing").alias("code"))
    empty = e.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.lit("").alias("key"), F.lit("nothing_expected").alias("code"))
    return gone.unionByName(empty)


@check("no_unexpected")
def no_unexpected(ctx: Context, dataset: str, keys: list[str]) -> DataFrame:
    return reconcile.unexpected(ctx.expected[dataset], ctx.actual[dataset], keys).select(_key(keys).alias("key"), F.lit("unexpected").alias("code"))


@check("values")
def values(ctx: Context, dataset: str, keys: list[str], fields: list[str], maps: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """maps: by field, the target's code for each expected one."""
    d = reconcile.mismatches(_mapped(ctx.expected[dataset], maps), ctx.actual[dataset], keys, fields)
    return d.select(F.concat_ws("/", _key(keys), "field").alias("key"), F.lit("value").alias("code"), "expected", "actual", F.col("field").alias("detail"))


@check("uniqueness")
def uniqueness(ctx: Context, dataset: str, keys: list[str]) -> DataFrame:
    return reconcile.repeated(ctx.actual[dataset], keys).select(_key(keys).alias("key"), F.lit("repeated").alias("code"), F.col("n").cast("string").alias("actual"))


@check("repeats")
def repeats(ctx: Context, dataset: str, keys: list[str], order: list[str]) -> DataFrame:
    r = reconcile.repeats_after_first(ctx.actual[dataset], keys, [F.col(c) for c in order])
    return r.select(F.concat_ws("/", _key(keys), "rn").alias("key"), F.lit("repeat").alias("code"))


@check("total")
def total(ctx: Context, dataset: str, measure: str, key: str, scale: int = 2) -> DataFrame:
    t = totals.compare_exact(ctx.expected[dataset], ctx.actual[dataset], measure, key, scale).where("NOT equal")
    return t.select(F.lit(measure).alias("key"), F.lit("total").alias("code"), F.col("expected_total").cast("string").alias("expected"), F.col("actual_total").cast("string").alias("actual"))


@check("group_totals")
def group_totals(ctx: Context, dataset: str, group: list[str], measure: str, **options) -> DataFrame:
    g = totals.grouped_totals(ctx.expected[dataset], ctx.actual[dataset], group, measure, **options)
    return g.select(_key(group).alias("key"), "code", F.col("expected_total").cast("string").alias("expected"), F.col("actual_total").cast("string").alias("actual"))


@check("keyed")
def keyed(ctx: Context, dataset: str, keys: list[str], fields: list[str], **options) -> DataFrame:
    return reconcile.keyed(ctx.expected[dataset], ctx.actual[dataset], keys, fields, **options).select(F.concat_ws("/", _key(keys), "code").alias("key"), "code")


@check("exactly_one")
def exactly_one(ctx: Context, dataset: str, keys: list[str], fields: list[str], maps: dict[str, dict[str, str]] | None = None) -> DataFrame:
    return reconcile.exactly_one(_mapped(ctx.expected[dataset], maps), ctx.actual[dataset], keys, fields).select(_key(keys).alias("key"), "code")


@check("owners")
def owners(ctx: Context, dataset: str, keys: list[str], owner: str, owners_dataset: str, owner_key: str, **options) -> DataFrame:
    o = reconcile.owners(ctx.expected[dataset], ctx.actual[dataset], keys, owner, ctx.actual[owners_dataset], owner_key, **options)
    return o.select(F.concat_ws("/", _key(keys), "code").alias("key"), "code")


@check("references")
def references(ctx: Context, dataset: str, reference: str, to: str, key: str, keys: list[str], kind: str | None = None) -> DataFrame:
    df, target = ctx.actual[dataset], ctx.actual[to]
    bad = reconcile.unresolved_typed(df, reference, kind, target, key) if kind else reconcile.unresolved(df, reference, target, key)
    return bad.select(_key(keys).alias("key"), F.lit("unresolved").alias("code"), F.col(reference).cast("string").alias("actual"))


@check("paired_values")
def paired_values(ctx: Context, dataset: str, keys: list[str], fields: list[str], order: list[str]) -> DataFrame:
    """Typed equality of the n-th expected and the n-th actual row of a key."""
    p = reconcile.paired(ctx.expected[dataset], ctx.actual[dataset], keys, order)
    same = reduce(lambda x, f: x & F.col(f"e.{f}").eqNullSafe(F.col(f"a.{f}")), fields, F.lit(True))
    return p.where(~same).select(F.concat_ws("/", _key(keys), "rn").alias("key"), F.lit("value").alias("code"))


@check("net")
def net(ctx: Context, dataset: str, keys: list[str], gross: str, deductions: str, result: str) -> DataFrame:
    """net = gross - deductions, on both sides."""
    sides = [df.where(~net_holds(F.col(gross), F.col(deductions), F.col(result))).select(F.concat_ws("/", F.lit(s), _key(keys)).alias("key"), F.lit("equation").alias("code")) for s, df in (("expected", ctx.expected[dataset]), ("actual", ctx.actual[dataset]))]
    return sides[0].unionByName(sides[1])


@check("same_instant_text")
def same_instant_text(ctx: Context, dataset: str, keys: list[str], at: str) -> DataFrame:
    """Offset timestamps of the n-th expected and the n-th actual row of a key are the same text, and are offset timestamps."""
    side = lambda df: df.select(*keys, F.col(at).alias("at"))
    p = reconcile.paired(side(ctx.expected[dataset]), side(ctx.actual[dataset]), keys, ["at"]).select(*keys, "rn", F.col("e.at").alias("e"), F.col("a.at").alias("a"))
    bad = F.when(~has_offset(F.col("a")), "no_offset").when(~F.col("e").eqNullSafe(F.col("a")), "text")
    key = F.when(F.col("rn") == 1, _key(keys)).otherwise(F.concat_ws("/", _key(keys), "rn"))
    return p.select(key.alias("key"), bad.alias("code"), F.col("e").alias("expected"), F.col("a").alias("actual")).where("code IS NOT NULL")


@check("digests")
def digests(ctx: Context, dataset: str, keys: list[str], hashed: str) -> DataFrame:
    """Each expected content is there, once, with the same digest."""
    e, a = ctx.expected[dataset].select(*keys, F.col(hashed).alias("e")), ctx.actual[dataset].groupBy(*keys).agg(F.min(F.lower(hashed)).alias("a"), F.max(F.lower(hashed)).alias("b"), F.count(F.lit(1)).alias("n"))
    same = same_digest(F.col("e"), F.col("a")) & same_digest(F.col("e"), F.col("b"))
    codes = F.array_compact(F.array(F.when(F.col("n").isNull(), F.lit("missing")), F.when(F.col("n") > 1, F.lit("repeated")), F.when(F.col("n").isNotNull() & ~same, F.lit("content"))))
    return e.join(a, keys, "left").select(_key(keys).alias("key"), F.explode(codes).alias("code"))


@check("event_positions")
def event_positions(ctx: Context, dataset: str, owner: str, order: list[str], date: str, code: str) -> DataFrame:
    """The n-th expected event of an owner is the n-th actual one."""
    return timelines.positional(ctx.expected[dataset], ctx.actual[dataset], owner, order, date, code).select(F.concat_ws("/", _key([owner]), "rn").alias("key"), F.col("fault").alias("code"))


@check("intervals")
def intervals(ctx: Context, dataset: str, owner: str, start: str, end: str, identity: str, **options) -> DataFrame:
    return timelines.interval_faults(ctx.actual[dataset], owner, start, end, identity, **options).select(_key([owner, identity]).alias("key"), "code")


@check("as_of")
def as_of(ctx: Context, dataset: str, owner: str, start: str, end: str, at: str) -> DataFrame:
    return timelines.as_of_faults(ctx.actual[dataset], owner, start, end, at).select(_key([owner]).alias("key"), F.lit("cardinality").alias("code"), F.col("n").cast("string").alias("actual"))


@check("series")
def series(ctx: Context, dataset: str, owner: str, sequence: str, at: str, identity: str, **options) -> DataFrame:
    return timelines.monotonic_faults(ctx.actual[dataset], owner, sequence, at, identity, **options).select(F.concat_ws("/", _key([owner, identity]), "code").alias("key"), "code")


@check("event_order")
def event_order(ctx: Context, dataset: str, keys: list[str], earlier: str, later: str) -> DataFrame:
    return timelines.order_faults(ctx.actual[dataset], keys, earlier, later).select(_key(keys).alias("key"), F.lit("order").alias("code"))


@check("accounting")
def accounted(ctx: Context) -> DataFrame:
    """Every source has exactly one fate; no sources at all is a fault."""
    faults = accounting.accounting_faults(ctx.sources, ctx.journal).select(F.col("source_key").alias("key"), "code")
    empty = ctx.sources.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.lit("").alias("key"), F.lit("no_sources").alias("code"))
    return faults.unionByName(empty)


@check("origin")
def origin(ctx: Context) -> DataFrame:
    return accounting.without_origin(ctx.targets, ctx.sources, ctx.journal).select(F.col("target_key").alias("key"), F.lit("no_origin").alias("code"))


#: Named sets of checks for a domain, as functions of dataset names; categories: a code's kind of discrepancy.
PACKS: dict[str, dict] = {
    "membership": {"checks": ("accounting", "repeats", "presence", "values", "event_positions", "intervals", "keyed", "group_totals", "owners", "exactly_one", "digests"), "categories": {"missing": "missing", "repeat": "duplicate", "repeated": "duplicate", "amount": "amount", "total": "amount", "owner": "relationship", "orphan": "relationship", "content": "document"}},
    "workforce": {"checks": ("references", "as_of", "paired_values", "net"), "categories": {"unresolved": "relationship", "cardinality": "timeline", "value": "value", "equation": "amount"}},
    "cases": {"checks": ("references", "paired_values", "event_order"), "categories": {"unresolved": "relationship", "value": "value", "order": "timeline"}},
    "billing": {"checks": ("paired_values", "references", "series", "group_totals"), "categories": {"unresolved": "relationship", "value": "value", "sequence": "timeline", "time": "timeline", "total": "amount"}},
    "clinical": {"checks": ("references", "same_instant_text", "paired_values"), "categories": {"unresolved": "relationship", "text": "timeline", "value": "value"}},
}


#: Columns of a finding before it is one.
_FOUND = "check int, code string, key string, expected string, actual string, detail string"


def _alone(ctx: Context, c: Check, i: int) -> DataFrame:
    """A check's findings by its own definition."""
    found = CHECKS[c.kind](ctx, **c.options)
    text = lambda n: (F.col(n) if n in found.columns else F.lit(None)).cast("string").alias(n)
    return found.select(F.lit(i).alias("check"), text("code"), text("key"), text("expected"), text("actual"), text("detail"))


def _of_keys(df: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of df whose keys, nulls included, are among rows."""
    same = reduce(lambda x, i: x & F.col(keys[i]).eqNullSafe(F.col(f"_key{i}")), range(len(keys)), F.lit(True))
    return df.join(rows.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)]), same, "left_semi")


def _narrowed(ctx: Context, c: Check) -> Context:
    """The context with the check's dataset cut to its part."""
    dataset = c.options.get("dataset")
    if c.only is None or dataset is None:
        return ctx
    part = lambda frames: {**frames, dataset: c.only.apply(frames[dataset])} if dataset in frames else frames
    return replace(ctx, expected=part(ctx.expected), actual=part(ctx.actual))


def verify(ctx: Context, checks: list[Check]) -> DataFrame:
    """All checks' findings, with one row a check that found nothing.

    Runs the checks: checks of one dataset and key share one pass over both sides (see plans.fused), all
    others are written together in one job, and what is returned reads what was written. Each finding is
    computed once; which checks found nothing is counted on the way. With redact, expected and actual
    values are digests; detail only ever names a field.
    """
    for c in checks:
        if c.kind not in CHECKS:
            raise ValueError(f"{c.check_id}: no check {c.kind!r}")
    spark = next(iter((ctx.expected | ctx.actual).values())).sparkSession
    counts, parts, rest, loose = dict.fromkeys(range(len(checks)), 0), [], [], []
    groups = fused.plan_groups(checks, ctx.expected)
    for group in groups:
        mine = {i: checks[i] for i in group}
        dataset, cut = checks[group[0]].options["dataset"], _narrowed(ctx, checks[group[0]])
        found, n, apart, extra = fused.answer(cut.expected[dataset], cut.actual[dataset], mine)
        counts |= n
        parts.append(found)
        loose += extra
        if apart is not None:  # by their own definitions, on these keys alone
            keys = apart.columns
            few = replace(cut, expected={**cut.expected, dataset: _of_keys(cut.expected[dataset], apart, keys)}, actual={**cut.actual, dataset: _of_keys(cut.actual[dataset], apart, keys)})
            rest += [_alone(few, c, i).where("code <> 'nothing_expected'") for i, c in mine.items() if c.kind in ("presence", "no_unexpected", "values")]
    together = {i for g in groups for i in g}
    rest += [_alone(_narrowed(ctx, c), c, i) for i, c in enumerate(checks) if i not in together]
    if rest:
        kept, seen = observed(reduce(DataFrame.unionByName, rest), {f"n{i}": F.count_if(F.col("check") == i) for i in counts})
        counts = {i: n + (seen[f"n{i}"] or 0) for i, n in counts.items()}
        parts.append(kept)
    loose += [(i, "clean", "", None, None, None) for i, n in counts.items() if not n]
    parts.append(spark.createDataFrame(loose, _FOUND))
    found = reduce(DataFrame.unionByName, parts)
    return _as_findings(spark, ctx, checks, found)


def _as_findings(spark: SparkSession, ctx: Context, checks: list[Check], found: DataFrame) -> DataFrame:
    """Findings of checks by their positions, in the fixed shape; one expression for all checks."""
    if not checks:
        return spark.createDataFrame([], FINDING)
    clean = F.col("code") == "clean"
    of = lambda get: F.element_at(F.array(*[F.lit(get(c)) for c in checks]), F.col("check") + 1)
    said = lambda n: redacted(F.col(n)) if ctx.redact else F.col(n)
    shown = found.withColumns({"check_id": of(lambda c: c.check_id), "kind": of(lambda c: c.kind), "of_dataset": of(lambda c: c.options.get("dataset", "")), "of_severity": of(lambda c: c.severity)})
    rows = as_findings(shown, check_id=F.col("check_id"), check_type=F.col("kind"), dataset=F.col("of_dataset"), code=F.col("code"), key="key", expected=said("expected"), actual=said("actual"), detail=F.col("detail"), result=F.when(clean, "pass").otherwise("fail"), severity=F.when(clean, "info").otherwise(F.col("of_severity")), run_id=ctx.run_id, scope=of(lambda c: c.only.scope_id if c.only else ctx.scope))
    return rows

"""Checks that are answered in one pass against their own definitions."""

import random
from dataclasses import replace
from decimal import Decimal

import pytest

from tidemark.plans import checks as module
from tidemark.plans import fused
from tidemark.plans.checks import Check, Context, verify
from tidemark.plans.scope import Predicate, Scope

SCHEMA = "id long, part string, name string, code string, pay decimal(12,2)"
COMMON = {"dataset": "p", "keys": ["id", "part"]}
CHECKS = [
    Check("there", "presence", COMMON), Check("explained", "no_unexpected", COMMON, "warning"), Check("values", "values", COMMON | {"fields": ["name", "pay"]}),
    Check("recoded", "values", COMMON | {"fields": ["code"], "maps": {"code": {"A": "active", "B": "blocked"}}}), Check("once", "uniqueness", COMMON), Check("total", "total", {"dataset": "p", "measure": "pay", "key": "id"}),
    Check("keyed", "keyed", COMMON | {"fields": ["name"], "amount": "pay"}),
]


def frames(spark, seed, n):
    rng = random.Random(seed)
    row = lambda: (rng.choice([None, *range(max(2, n // 2))]), rng.choice([None, "x", "y"]), rng.choice([None, "n", "m"]), rng.choice(["A", "B", "active", None]), rng.choice([None, Decimal("1.00"), Decimal("2.50")]))
    e = [row() for _ in range(n)]
    a = [r for r in e if rng.random() < 0.8] + [row() for _ in range(n // 3)]
    return spark.createDataFrame(e, SCHEMA), spark.createDataFrame(a, SCHEMA)


def bag(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("seed,n", [(1, 60), (2, 12), (3, 0), (4, 200)])
def test_equals_each_check_alone(spark, monkeypatch, seed, n):
    e, a = frames(spark, seed, n)
    for redact in (False, True):
        ctx = Context({"p": e}, {"p": a}, run_id="r", redact=redact)
        got = bag(verify(ctx, CHECKS))
        monkeypatch.setattr(fused, "plan_groups", lambda checks, expected: [])
        assert bag(verify(ctx, CHECKS)) == got
        monkeypatch.undo()


def test_only_a_part(spark, monkeypatch):
    """Checks of parts: in one pass or alone, findings are those of the cut frames and carry the part's name."""
    e, a = frames(spark, 5, 80)
    part = Scope("x", (Predicate("equals", "part", ("x",)),))
    mine = [*CHECKS[:3], *(replace(c, check_id=c.check_id + "_x", only=part) for c in CHECKS)]
    assert fused.plan_groups(mine, {"p": e}) == [[0, 1, 2], [3, 4, 5, 6, 7, 8]]
    rows = verify(Context({"p": e}, {"p": a}), mine)
    got, alone = bag(rows), verify(Context({"p": e.where("part = 'x'")}, {"p": a.where("part = 'x'")}), CHECKS)
    assert sorted(map(str, rows.where("scope = 'x'").select("code", "expected", "actual", "detail").collect())) == sorted(map(str, alone.select("code", "expected", "actual", "detail").collect()))
    monkeypatch.setattr(fused, "plan_groups", lambda checks, expected: [])
    assert bag(verify(Context({"p": e}, {"p": a}), mine)) == got


def test_groups(spark):
    e, _ = frames(spark, 1, 4)
    assert fused.plan_groups(CHECKS, {"p": e}) == [[0, 1, 2, 3, 4, 5]]
    assert fused.plan_groups(CHECKS[:1] + CHECKS[5:], {"p": e}) == [[0, 1]]
    assert fused.plan_groups(CHECKS[5:], {"p": e}) == [] and fused.plan_groups(CHECKS[:1], {"p": e}) == []


def test_one_exchange(spark, sf_dir, monkeypatch):
    """Both sides of all checks of a dataset meet in one exchange."""
    from tidemark.plans import catalog

    seen = []
    real = fused.observed
    monkeypatch.setattr(fused, "observed", lambda df, *rest: seen.append(df._jdf.queryExecution().executedPlan().toString()) or real(df, *rest))
    catalog.flagship(spark, sf_dir).count()
    assert len(seen) == 1 and seen[0].count("Exchange hashpartitioning") == 1 and seen[0].count("FileScan") == 2
    with pytest.raises(TypeError):
        verify(Context({"p": frames(spark, 1, 4)[0]}, {"p": frames(spark, 1, 4)[1].drop("pay")}), CHECKS[:3])
    assert module.CHECKS.keys() >= set(fused.BY_KEY)

"""Every query of the catalogue against its SQL in DuckDB, on the driver's tables."""

import pytest

from tidemark.plans import catalog


def text(v):
    return "null" if v is None or v != v else str(v)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_equals_sql(name, spark, sf_dir, duck):
    df = catalog.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    reference = duck.sql(catalog.oracle_sql()[name])
    assert sorted(reference.columns) == columns
    got = sorted(tuple(map(text, r)) for r in df.select(*columns).collect())
    assert got == sorted(tuple(map(text, r)) for r in reference.select(*columns).fetchall())


def test_flagship(spark, sf_dir):
    rows = catalog.flagship(spark, sf_dir).collect()
    assert len({r.stable_key for r in rows}) == len(rows) > 0
    assert {r.check_id for r in rows} == {"orders_there", "orders_explained", "orders_values", "orders_once", "orders_total"}


def test_column_pruning_and_pushdown(spark, sf_dir):
    plan = catalog.queries()["scope_equals"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "EqualTo(o_orderstatus,F)" in plan
    assert "o_orderpriority" not in plan.split("ReadSchema: ")[1].split("\n")[0]

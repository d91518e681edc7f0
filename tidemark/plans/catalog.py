"""The named queries over the driver's tables, with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.functions.canonical import LANES, row_fingerprint, set_lanes
from tidemark.operators import accounting, profile, reconcile, runs, timelines, totals
from tidemark.plans import frames as f
from tidemark.plans import stored
from tidemark.plans.checks import CHECKS, Check, Context, verify
from tidemark.plans.mapping import Edge, Plan, expected_state
from tidemark.plans.scope import Predicate, Scope
from tidemark.sources import readers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

KEY = ["o_orderkey"]
FIELDS = ["o_custkey", "o_orderstatus", "price", "order_date", "o_orderpriority"]


def query(sql: str | None, name: str | None = None):
    def register(q: Query) -> Query:
        QUERIES[name or q.__name__] = q
        if sql:
            SQL[name or q.__name__] = sql
        return q

    return register


def sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return f.expected_orders(spark, d), f.actual_orders(spark, d)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All findings of a reconciliation of orders: presence, surplus, values, repeats and totals."""
    e, a = sides(spark, sf_dir)
    ctx = Context({"orders": e}, {"orders": a}, run_id="flagship")
    common = {"dataset": "orders", "keys": KEY}
    return verify(ctx, [
        Check("orders_there", "presence", common), Check("orders_explained", "no_unexpected", common), Check("orders_values", "values", common | {"fields": FIELDS}),
        Check("orders_once", "uniqueness", common), Check("orders_total", "total", {"dataset": "orders", "measure": "price", "key": "o_orderkey"}),
    ])


@query(f"WITH {f.ORDERS} SELECT e.* FROM e WHERE o_orderkey NOT IN (SELECT o_orderkey FROM a)")
def presence_missing(spark, d):
    return reconcile.missing(*sides(spark, d), KEY)


@query(f"WITH {f.ORDERS} SELECT a.* FROM a WHERE o_orderkey NOT IN (SELECT o_orderkey FROM e)")
def unexpected_target(spark, d):
    return reconcile.unexpected(*sides(spark, d), KEY)


def _differ(c: str) -> str:
    return f"SELECT e.o_orderkey, '{c}' AS field, CAST(e.{c} AS VARCHAR) AS expected, CAST(a.{c} AS VARCHAR) AS actual FROM e JOIN a USING (o_orderkey) JOIN once USING (o_orderkey) WHERE e.{c} IS DISTINCT FROM a.{c}"


@query(f"WITH {f.ORDERS} " + " UNION ALL ".join(map(_differ, FIELDS)))
def attribute_mismatch(spark, d):
    return reconcile.mismatches(*sides(spark, d), KEY, FIELDS)


@query(f"WITH {f.ORDERS} SELECT count(*) AS n_compared, count(*) FILTER (" + " AND ".join(f"e.{c} IS NOT DISTINCT FROM a.{c}" for c in FIELDS) + ") AS n_matching FROM e JOIN a USING (o_orderkey) JOIN once USING (o_orderkey)")
def population_summary(spark, d):
    return reconcile.compared(*sides(spark, d), KEY, FIELDS)


@query(f"WITH {f.ORDERS} SELECT o_orderkey, count(*) AS n, min(price) AS least_price FROM a GROUP BY 1 HAVING count(*) > 1")
def duplicate_identity(spark, d):
    return reconcile.repeated(f.actual_orders(spark, d), KEY, "price")


@query(f"WITH {f.ORDERS} SELECT o_orderkey, price, CAST(rn AS INTEGER) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY price) AS rn FROM a) WHERE rn > 1")
def duplicate_after_first(spark, d):
    return reconcile.repeats_after_first(f.actual_orders(spark, d), KEY, [F.col("price")]).select("o_orderkey", "price", "rn")


@query(f"WITH {f.ORDERS} SELECT e.o_orderkey, (SELECT count(*) FROM a WHERE a.o_orderkey = e.o_orderkey) AS n_observed FROM e")
def observed_multiplicity(spark, d):
    return reconcile.observed_counts(*sides(spark, d), KEY).select("o_orderkey", "n_observed")


_TOTAL = "CAST(sum(v) AS DECIMAL(38,2)) AS total, count(*) AS n, count(*) FILTER (v IS NULL) AS bad, min(o_orderkey) FILTER (v IS NULL) AS first_bad"


@query(f"""WITH {f.ORDERS}, x AS (SELECT {_TOTAL} FROM (SELECT o_orderkey, price AS v FROM e)), y AS (SELECT {_TOTAL} FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 131 <> 0 THEN price END AS v FROM a))
SELECT x.total AS expected_total, x.n AS expected_n_rows, x.bad AS expected_n_invalid, x.first_bad AS expected_first_invalid, FALSE AS expected_overflowed,
  y.total AS actual_total, y.n AS actual_n_rows, y.bad AS actual_n_invalid, y.first_bad AS actual_first_invalid, FALSE AS actual_overflowed, x.bad + y.bad = 0 AND x.total = y.total AS equal FROM x, y""")  # fmt: skip
def total_compare(spark, d):
    e, a = sides(spark, d)
    return totals.compare_exact(e, a.withColumn("price", F.when(F.col("o_orderkey") % 131 != 0, F.col("price"))), "price", "o_orderkey")


def _groups(e: str, a: str, g: str, v: str, tolerance: str) -> str:
    return f"""ge AS (SELECT {g}, count(*) AS n, CAST(sum(coalesce({v}, 0)) AS DECIMAL(38,2)) AS t FROM {e} GROUP BY ALL), ga AS (SELECT {g}, count(*) AS n, CAST(sum(coalesce({v}, 0)) AS DECIMAL(38,2)) AS t FROM {a} GROUP BY ALL),
g AS (SELECT {g}, ge.n AS expected_n, ge.t AS expected_total, ga.n AS actual_n, ga.t AS actual_total FROM ge FULL JOIN ga USING ({g}))
SELECT *, CASE WHEN actual_n IS NULL THEN 'missing' WHEN expected_n IS NULL THEN 'unexpected' WHEN expected_n <> actual_n THEN 'count' WHEN abs(expected_total - actual_total) > {tolerance} THEN 'total' END AS code FROM g
WHERE actual_n IS NULL OR expected_n IS NULL OR expected_n <> actual_n OR abs(expected_total - actual_total) > {tolerance}"""


@query(f"WITH {f.ORDERS}, em AS (SELECT *, strftime(order_date, '%Y-%m') AS month FROM e), am AS (SELECT *, strftime(order_date, '%Y-%m') AS month FROM a), " + _groups("em", "am", "o_custkey, month", "price", "0.01"))
def grouped_totals(spark, d):
    e, a = (x.withColumn("month", F.date_format("order_date", "yyyy-MM")) for x in sides(spark, d))
    return totals.grouped_totals(e, a, ["o_custkey", "month"], "price", tolerance=0.01)


_LINES = "le AS (SELECT l_orderkey, CAST(l_extendedprice AS DECIMAL(18,2)) AS price FROM lineitem), la AS (SELECT l_orderkey, CAST(l_extendedprice AS DECIMAL(18,2)) + CASE WHEN (l_orderkey * 7 + l_linenumber) % 61 = 0 THEN 0.01 ELSE 0 END AS price FROM lineitem WHERE l_orderkey % 59 <> 0)"


@query(f"WITH {_LINES}, " + _groups("le", "la", "l_orderkey", "price", "0"))
def grouped_totals_strict(spark, d):
    lines = f.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").cast(f.MONEY).alias("price"))
    moved = lines.where("l_orderkey % 59 <> 0").withColumn("price", F.col("price") + F.when((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 61 == 0, F.lit("0.01").cast(f.MONEY)).otherwise(F.lit(0)))
    return totals.grouped_totals(lines, moved, ["l_orderkey"], "price", on_invalid="raise")


def _booked(spark, d):
    return f.sources(spark, d), f.journal(spark, d)


@query(f"WITH {f.JOURNAL} SELECT * FROM (SELECT source_key, CASE WHEN (p > 0 AND x > 0) OR (fl > 0 AND (p > 0 OR x > 0)) THEN 'conflict' WHEN fl > 0 THEN 'failed' WHEN p = 0 AND x = 0 THEN 'unaccounted' END AS code FROM f) WHERE code IS NOT NULL")
def source_accounting(spark, d):
    return accounting.accounting_faults(*_booked(spark, d))


@query(f"WITH {f.JOURNAL} SELECT target_key FROM t WHERE target_key NOT IN (SELECT target_key FROM l)")
def target_lineage(spark, d):
    return accounting.without_origin(f.targets(spark, d), *_booked(spark, d))


@query(f"WITH {f.JOURNAL} SELECT target_key, array_to_string(sources, ',') AS sources, array_to_string(edges, ',') AS edges FROM l")
def lineage_build(spark, d):
    return accounting.lineage(*_booked(spark, d)).select("target_key", F.array_join("sources", ",").alias("sources"), F.array_join("edges", ",").alias("edges"))


_DISPOSED = "SELECT source_key, CASE WHEN fl > 0 THEN 'failed' WHEN p > 0 AND x = 0 THEN CASE WHEN list_contains(edges, 'archive_closed') THEN 'archived' WHEN list_contains(edges, 'map_pending') THEN 'transformed' ELSE 'migrated' END WHEN x > 0 AND p = 0 THEN 'excluded' ELSE 'unaccounted' END AS disposition, targets FROM f"


@query(f"WITH {f.JOURNAL} SELECT source_key, disposition, array_to_string(targets, ',') AS targets FROM ({_DISPOSED})")
def disposition(spark, d):
    return accounting.dispositions(*_booked(spark, d), f.OPERATIONS).withColumn("targets", F.array_join("targets", ","))


@query(f"""WITH {f.JOURNAL}, p AS ({_DISPOSED})
SELECT 'disposition_missing' AS what, count(*) AS n FROM s WHERE source_key NOT IN (SELECT source_key FROM p) UNION ALL SELECT 'disposition_unexpected', count(*) FROM p WHERE source_key NOT IN (SELECT source_key FROM s)
UNION ALL SELECT 'disposition_unaccounted', count(*) FROM p WHERE disposition = 'unaccounted' UNION ALL SELECT 'lineage_missing', count(*) FROM t WHERE target_key NOT IN (SELECT target_key FROM l)
UNION ALL SELECT 'lineage_unexpected', count(*) FROM l WHERE target_key NOT IN (SELECT target_key FROM t) UNION ALL SELECT 'lineage_unbound', count(*) FROM (SELECT unnest(sources) AS k FROM l) WHERE k NOT IN (SELECT source_key FROM s)""")  # fmt: skip
def coverage_summary(spark, d):
    s, j = _booked(spark, d)
    return accounting.coverage(s, accounting.dispositions(s, j, f.OPERATIONS), f.targets(spark, d), accounting.lineage(s, j))


@query(f"""WITH {f.JOURNAL}, known AS (SELECT 'T' || o_orderkey AS target_key FROM orders WHERE o_orderkey % 89 <> 0), cut AS (SELECT source_key FROM s WHERE CAST(source_key AS BIGINT) % 79 <> 0)
SELECT edge, source_key, target_key, 'unknown_edge' AS code FROM j WHERE edge = 'map_pending' UNION ALL SELECT edge, source_key, target_key, 'unknown_source' FROM j WHERE source_key NOT IN (SELECT source_key FROM cut)
UNION ALL SELECT edge, source_key, target_key, 'unknown_target' FROM j WHERE result = 'produced' AND target_key NOT IN (SELECT target_key FROM known)
UNION ALL SELECT edge, source_key, target_key, 'repeated' FROM j GROUP BY ALL HAVING count(*) > 1""")  # fmt: skip
def journal_check(spark, d):
    s, j = _booked(spark, d)
    known = f.table(spark, d, "orders").where("o_orderkey % 89 <> 0").select(F.concat(F.lit("T"), "o_orderkey").alias("target_key"))
    legal = {k: v for k, v in f.OPERATIONS.items() if k != "map_pending"}
    return accounting.journal_faults(j, s.where(F.col("source_key").cast("bigint") % 79 != 0), known, legal)


@query(f"WITH {f.JOURNAL} SELECT edge, count(DISTINCT source_key) AS n_sources, count(DISTINCT target_key) AS n_targets FROM j GROUP BY 1")
def journal_scope(spark, d):
    return accounting.journal_scope(f.journal(spark, d))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_shipdate AS DATE) AS shipped FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 97 <> 0)")
def reference_unresolved(spark, d):
    kept = f.table(spark, d, "orders").where("o_orderkey % 97 <> 0")
    lines = f.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_shipdate").cast("date").alias("shipped"))
    return reconcile.unresolved(lines, "l_orderkey", kept, "o_orderkey")


@query("""WITH r AS (SELECT o_orderkey, CASE o_orderkey % 10 WHEN 3 THEN 'Supplier/' WHEN 4 THEN 'Customer//' ELSE 'Customer/' END || o_custkey AS ref FROM orders)
SELECT o_orderkey, ref FROM r WHERE nullif(regexp_extract(ref, '^Customer/([^/]+)$', 1), '') IS NULL OR regexp_extract(ref, '^Customer/([^/]+)$', 1) NOT IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_custkey % 31 <> 0)""")
def typed_reference(spark, d):
    k = F.col("o_orderkey") % 10
    refs = f.table(spark, d, "orders").select("o_orderkey", F.concat(F.when(k == 3, "Supplier/").when(k == 4, "Customer//").otherwise("Customer/"), "o_custkey").alias("ref"))
    return reconcile.unresolved_typed(refs, "ref", "Customer", f.table(spark, d, "customer").where("c_custkey % 31 <> 0"), "c_custkey")


@query(f"""WITH {f.ORDERS}, ga AS (SELECT o_orderkey, count(*) AS n, min(struct_pack(price, o_orderstatus)) AS r FROM a GROUP BY 1),
x AS (SELECT e.o_orderkey, ga.n, abs(e.price - r.price) > 0.01 AS off, e.o_orderstatus <> r.o_orderstatus AS differ FROM e LEFT JOIN ga USING (o_orderkey))
SELECT o_orderkey, 'missing' AS code FROM x WHERE n IS NULL UNION ALL SELECT o_orderkey, 'repeated' FROM x WHERE n > 1 UNION ALL SELECT o_orderkey, 'amount' FROM x WHERE off UNION ALL SELECT o_orderkey, 'fields' FROM x WHERE differ AND NOT off""")
def keyed_accounting(spark, d):
    return reconcile.keyed(*sides(spark, d), KEY, ["o_orderstatus"], amount="price", tolerance=0.01)


@query(f"""WITH {f.ORDERS}, ga AS (SELECT o_orderkey, count(*) AS n, min(o_orderpriority) AS p, min(o_orderstatus) AS st FROM a GROUP BY 1)
SELECT * FROM (SELECT e.o_orderkey, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'repeated' WHEN o_orderpriority <> p OR o_orderstatus <> st THEN 'fields' END AS code FROM e LEFT JOIN ga USING (o_orderkey)) WHERE code IS NOT NULL""")
def exactly_one(spark, d):
    return reconcile.exactly_one(*sides(spark, d), KEY, ["o_orderpriority", "o_orderstatus"])


@query(f"""WITH {f.ORDERS}, am AS (SELECT o_orderkey, count(*) AS n, min(CASE WHEN o_orderkey % 71 = 0 THEN o_custkey + 1 ELSE o_custkey END) AS own FROM a GROUP BY 1),
x AS (SELECT e.o_orderkey, n, o_custkey <> own AS other, c_custkey IS NULL AS orphan FROM e LEFT JOIN am USING (o_orderkey) LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 31 <> 0) ON own = c_custkey)
SELECT o_orderkey, 'missing' AS code FROM x WHERE n IS NULL UNION ALL SELECT o_orderkey, 'repeated' FROM x WHERE n > 1 UNION ALL SELECT o_orderkey, 'owner' FROM x WHERE other UNION ALL SELECT o_orderkey, 'orphan' FROM x WHERE n IS NOT NULL AND orphan""")
def relationship_owner(spark, d):
    e, a = sides(spark, d)
    a = a.withColumn("o_custkey", F.when(F.col("o_orderkey") % 71 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")))
    return reconcile.owners(e, a, KEY, "o_custkey", f.table(spark, d, "customer").where("c_custkey % 31 <> 0"), "c_custkey")


@query(f"""WITH {f.ORDERS}, x AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY price) AS rn FROM e), y AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY price) AS rn FROM a)
SELECT o_orderkey, CAST(rn AS INTEGER) AS rn FROM x JOIN y USING (o_orderkey, rn) WHERE x.o_orderstatus IS DISTINCT FROM y.o_orderstatus OR x.price IS DISTINCT FROM y.price""")
def typed_equality(spark, d):
    p = reconcile.paired(*sides(spark, d), KEY, ["price"])
    return p.where(~F.col("e.o_orderstatus").eqNullSafe(F.col("a.o_orderstatus")) | ~F.col("e.price").eqNullSafe(F.col("a.price"))).select("o_orderkey", "rn")


_PAIRS = "SELECT l_orderkey, l_linenumber, CAST({q} AS DECIMAL(18,2)) AS quantity, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY CAST({q} AS DECIMAL(18,2))) AS rn FROM lineitem"


@query("WITH x AS (" + _PAIRS.format(q="l_quantity") + "), y AS (" + _PAIRS.format(q="l_quantity + CASE WHEN l_partkey % 53 = 0 THEN 1 ELSE 0 END") + ") SELECT l_orderkey, l_linenumber, CAST(rn AS INTEGER) AS rn, x.quantity AS expected, y.quantity AS actual FROM x JOIN y USING (l_orderkey, l_linenumber, rn) WHERE x.quantity <> y.quantity")
def positional_pairs(spark, d):
    q = lambda more: f.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") + more).cast(f.MONEY).alias("quantity"))
    p = reconcile.paired(q(F.lit(0)), q(F.when(F.col("l_partkey") % 53 == 0, 1).otherwise(0)), ["l_orderkey", "l_linenumber"], ["quantity"])
    return p.where("e.quantity <> a.quantity").select("l_orderkey", "l_linenumber", "rn", F.col("e.quantity").alias("expected"), F.col("a.quantity").alias("actual"))


_NET = "CAST(l_extendedprice AS DECIMAL(18,2)) AS gross, CAST(l_quantity AS DECIMAL(18,2)) AS off, CAST(l_extendedprice AS DECIMAL(18,2)) - CAST(l_quantity AS DECIMAL(18,2)) + CASE WHEN l_partkey % 47 = 0 THEN 0.01 ELSE 0 END AS net"


@query(f"SELECT l_orderkey, l_linenumber, gross, CAST(net AS DECIMAL(20,2)) AS net FROM (SELECT l_orderkey, l_linenumber, {_NET} FROM lineitem) WHERE net <> gross - off")
def net_equation(spark, d):
    gross, off = F.col("l_extendedprice").cast(f.MONEY), F.col("l_quantity").cast(f.MONEY)
    rows = f.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", gross.alias("gross"), off.alias("off"), (gross - off + F.when(F.col("l_partkey") % 47 == 0, F.lit("0.01").cast(f.MONEY)).otherwise(F.lit(0))).alias("net"))
    return rows.where(~C.net_holds(F.col("gross"), F.col("off"), F.col("net"))).select("l_orderkey", "l_linenumber", "gross", F.col("net").cast("decimal(20,2)").alias("net"))


_SPANS = "v AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 211 <> 0 THEN CAST(o_orderdate AS DATE) END AS start_, CASE WHEN o_orderkey % 10 <> 0 THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 60 - 2 AS INTEGER) END AS end_ FROM orders)"


def _spans(spark, d):
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    return f.table(spark, d, "orders").select("o_orderkey", "o_custkey", F.when(k % 211 != 0, day).alias("start_"), F.when(k % 10 != 0, F.date_add(day, (k % 60 - 2).cast("int"))).alias("end_"))


@query(f"""WITH {_SPANS}, w AS (SELECT *, lag(end_) OVER o AS was, lag(end_ IS NULL) OVER o AS open_, start_ IS NOT NULL AND (end_ IS NULL OR end_ >= start_) AS ok FROM v WINDOW o AS (PARTITION BY o_custkey ORDER BY start_ NULLS FIRST, o_orderkey))
SELECT * FROM (SELECT o_custkey, o_orderkey, CASE WHEN start_ IS NULL THEN 'no_start' WHEN NOT ok THEN 'reversed' END AS code FROM w UNION ALL
SELECT o_custkey, o_orderkey, CASE WHEN NOT ok THEN NULL WHEN open_ THEN 'after_open' WHEN start_ <= was THEN 'overlap' WHEN start_ - was > 1 THEN 'gap' END FROM w) WHERE code IS NOT NULL""")
def interval_check(spark, d):
    return timelines.interval_faults(_spans(spark, d), "o_custkey", "start_", "end_", "o_orderkey", continuous=True)


@query(f"WITH {_SPANS} SELECT o_custkey, count(*) FILTER (start_ <= DATE '1997-06-15' AND (end_ IS NULL OR end_ >= DATE '1997-06-15')) AS n FROM v GROUP BY 1 HAVING n <> 1")
def as_of_cardinality(spark, d):
    return timelines.as_of_faults(_spans(spark, d), "o_custkey", "start_", "end_", "1997-06-15")


_STATES = "st AS (SELECT event_id, user_id, ts, event_type <> 'error' AS on_ FROM events), sw AS (SELECT *, lag(on_) OVER o AS was, max(CAST(on_ AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ever FROM st WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id)), ch AS (SELECT * FROM (SELECT user_id, ts AS date, CASE WHEN on_ AND coalesce(ever, 0) = 0 THEN 'joined' WHEN on_ AND NOT was THEN 'resumed' WHEN NOT on_ AND coalesce(was, FALSE) THEN 'ended' END AS code FROM sw) WHERE code IS NOT NULL)"


def _changes(spark, d, kind="error"):
    return timelines.state_changes(f.table(spark, d, "events"), "user_id", ["ts", "event_id"], F.col("event_type") != kind, "ts")


@query(f"WITH {_STATES} SELECT user_id, epoch_us(date) AS at, code FROM ch")
def state_changes(spark, d):
    return _changes(spark, d).select("user_id", F.unix_micros(F.col("date").cast("timestamp")).alias("at"), "code")


@query(f"""WITH {_STATES}, x AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY date) AS rn FROM ch), y0 AS (SELECT * FROM ch WHERE epoch_us(date) % 23 <> 0), y AS (SELECT user_id, date, CASE WHEN epoch_us(date) % 19 = 0 THEN 'other' ELSE code END AS code, row_number() OVER (PARTITION BY user_id ORDER BY date) AS rn FROM y0)
SELECT * FROM (SELECT user_id, CAST(rn AS INTEGER) AS rn, CASE WHEN y.date IS NULL THEN 'missing' WHEN x.date IS NULL THEN 'extra' WHEN x.date <> y.date THEN 'date' WHEN x.code <> y.code THEN 'code' END AS fault FROM x FULL JOIN y USING (user_id, rn)) WHERE fault IS NOT NULL""")
def positional_events(spark, d):
    e = _changes(spark, d)
    us = F.unix_micros(F.col("date").cast("timestamp"))
    a = e.where(us % 23 != 0).withColumn("code", F.when(us % 19 == 0, "other").otherwise(F.col("code")))
    return timelines.positional(e, a, "user_id", ["date"], "date", "code")


@query("""WITH r AS (SELECT user_id, event_id, CASE WHEN event_id % 29 <> 0 THEN event_id - CASE WHEN event_id % 37 = 0 THEN 200 ELSE 0 END END AS seq, epoch_us(ts) AS tm, CAST(value AS DECIMAL(18,2)) - CASE WHEN event_id % 41 = 0 THEN 1000 ELSE 0 END AS usage FROM events),
w AS (SELECT *, seq IS NOT NULL AND tm IS NOT NULL AS ok, last_value(CASE WHEN seq IS NOT NULL AND tm IS NOT NULL THEN seq END IGNORE NULLS) OVER o AS lseq, last_value(CASE WHEN seq IS NOT NULL AND tm IS NOT NULL THEN tm END IGNORE NULLS) OVER o AS lat
  FROM r WINDOW o AS (PARTITION BY user_id ORDER BY seq NULLS FIRST, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT user_id, event_id, 'sequence' AS code FROM w WHERE NOT ok OR seq <= lseq UNION ALL SELECT user_id, event_id, 'time' FROM w WHERE tm <= lat UNION ALL SELECT user_id, event_id, 'negative' FROM w WHERE usage < 0 OR usage IS NULL""")
def sequence_monotonic(spark, d):
    k = F.col("event_id")
    seq = F.when(k % 29 != 0, k - F.when(k % 37 == 0, 200).otherwise(0))
    rows = f.table(spark, d, "events").select("user_id", "event_id", seq.alias("seq"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), (F.col("value").cast(f.MONEY) - F.when(k % 41 == 0, 1000).otherwise(0)).alias("usage"))
    return timelines.monotonic_faults(rows, "user_id", "seq", "at", "event_id", usage="usage")


@query("SELECT l_orderkey, l_linenumber, CAST(o_orderdate AS DATE) AS ordered, CAST(l_shipdate AS DATE) AS shipped FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE NOT coalesce(CAST(o_orderdate AS DATE) <= CAST(l_shipdate AS DATE), FALSE)")
def event_order(spark, d):
    lines = f.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_shipdate").cast("date").alias("shipped"))
    both = lines.join(f.table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").cast("date").alias("ordered")), "l_orderkey")
    return timelines.order_faults(both, ["l_orderkey", "l_linenumber"], "ordered", "shipped")


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'closed' ELSE o_orderstatus END AS kept, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'closed' ELSE 'other' END AS filled, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'closed' END AS strict FROM orders")
def code_map(spark, d):
    s, codes = F.col("o_orderstatus"), {"O": "open", "F": "closed"}
    return f.table(spark, d, "orders").select("o_orderkey", C.code_map(s, codes, "keep").alias("kept"), C.code_map(s, codes, "default", "other").alias("filled"), C.code_map(s, codes).alias("strict"))


@query("SELECT p_partkey, array_to_string(string_split(p_name, ' '), '|') AS parts, CAST(len(string_split(p_name, ' ')) AS INTEGER) AS n FROM part")
def split_field(spark, d):
    return f.table(spark, d, "part").withColumn("x", C.split_literal(F.col("p_name"), " ")).select("p_partkey", F.array_join("x", "|").alias("parts"), F.size("x").alias("n"))


@query("SELECT p_partkey, p_brand || '/' || CASE WHEN p_size % 7 <> 0 THEN p_type END AS joined FROM part")
def concat_field(spark, d):
    return f.table(spark, d, "part").select("p_partkey", C.join_strict("/", F.col("p_brand"), F.when(F.col("p_size") % 7 != 0, F.col("p_type"))).alias("joined"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 9 <> 0 THEN CAST(o_orderdate AS DATE) END AS day FROM orders")
def normalize_date(spark, d):
    text = F.when(F.col("o_orderkey") % 9 == 0, "31.31.1997").otherwise(F.date_format("o_orderdate", "dd.MM.yyyy"))
    return f.table(spark, d, "orders").select("o_orderkey", C.parse_date(text, "dd.MM.yyyy").alias("day"))


@query("SELECT p_partkey, p_name AS name FROM part")
def trim_field(spark, d):
    padded = F.concat(F.lit(" \t "), "p_name", F.lit(" \n "))
    return f.table(spark, d, "part").select("p_partkey", C.strip(padded).alias("name"))


@query("SELECT p_partkey, upper(p_name) AS name FROM part")
def normalize_name(spark, d):
    return f.table(spark, d, "part").select("p_partkey", C.normalize_upper("p_name").alias("name"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CASE WHEN event_id % 4 <> 0 THEN CAST(round(value * 100) AS BIGINT) END AS cents FROM events")
def declared_text(spark, d):
    cents = F.when(F.col("event_id") % 4 == 0, "n/a").otherwise(F.concat(F.lit(" "), F.round(F.col("value") * 100).cast("bigint").cast("string")))
    return f.table(spark, d, "events").select("event_id", C.declared(F.get_json_object("props", "$.k"), "integer").alias("k"), C.declared(cents, "integer", null_text="n/a").alias("cents"))


@query("""SELECT 'open' AS target, o_orderkey, 'copy_open' AS edge FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT 'closed', o_orderkey, 'fan_closed' FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'audit', o_orderkey, 'fan_closed' FROM orders WHERE o_orderstatus = 'F'""")
def mapping_fanout(spark, d):
    plan = Plan((Edge("copy_open", "orders", ("open",), "copy", where="o_orderstatus = 'O'"), Edge("fan_closed", "orders", ("closed", "audit"), "split", where="o_orderstatus = 'F'"), Edge("drop_pending", "orders", (), "exclude", where="o_orderstatus = 'P'")), dict.fromkeys(("orders", "open", "closed", "audit"), ("o_orderkey",)))
    made, _, _ = expected_state(plan, {"orders": f.expected_orders(spark, d)})
    parts = [df.select(F.lit(t).alias("target"), "o_orderkey", F.col("_edge").alias("edge")) for t, df in made.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT CASE o_orderstatus WHEN 'P' THEN 'excluded' ELSE 'produced' END AS result, count(*) AS n FROM orders GROUP BY 1")
def mapping_journal(spark, d):
    plan = Plan((Edge("keep", "orders", ("kept",), "map", {"o_orderkey": ("o_orderkey", ()), "status": ("o_orderstatus", (C.strip,))}, where="o_orderstatus <> 'P'"), Edge("drop", "orders", (), "exclude", where="o_orderstatus = 'P'")), dict.fromkeys(("orders", "kept"), ("o_orderkey",)))
    _, _, journal = expected_state(plan, {"orders": f.expected_orders(spark, d)})
    return journal.groupBy("result").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, 'status' AS field FROM orders WHERE o_orderstatus = 'P'")
def mapping_rejects(spark, d):
    known: Callable[[Column], Column] = lambda c: C.code_map(c, {"O": "open", "F": "closed"})
    plan = Plan((Edge("recode", "orders", ("out",), "map", {"o_orderkey": ("o_orderkey", ()), "status": ("o_orderstatus", (known,))}),), dict.fromkeys(("orders", "out"), ("o_orderkey",)))
    _, rejects, _ = expected_state(plan, {"orders": f.expected_orders(spark, d)}, on_reject="keep")
    return rejects.select(F.split_part("_source_key", F.lit(":"), F.lit(2)).cast("bigint").alias("o_orderkey"), "field")


def _scope(kind: str, field: str, values: tuple[str, ...], where: str) -> None:
    @query(f"WITH {f.ORDERS} SELECT o_orderkey, price FROM e WHERE {where}", f"scope_{kind}")
    def run(spark, d):
        return Scope("part", (Predicate(kind, field, values),)).apply(f.expected_orders(spark, d)).select("o_orderkey", "price")


_scope("equals", "o_orderstatus", ("F",), "o_orderstatus = 'F'")
_scope("not_equals", "o_orderstatus", ("F",), "o_orderstatus <> 'F'")
_scope("in", "o_orderpriority", ("1-URGENT", "5-LOW"), "o_orderpriority IN ('1-URGENT', '5-LOW')")
_scope("range", "price", ("1000", "50000"), "price BETWEEN 1000 AND 50000")
_scope("time_range", "order_date", ("1997-01-01", "1997-12-31"), "order_date BETWEEN DATE '1997-01-01' AND DATE '1997-12-31'")
_scope("is_null", "order_date", (), "order_date IS NULL")
_scope("not_null", "order_date", (), "order_date IS NOT NULL")

_ROW = "sha256('10:o_orderkey' || octet_length(encode(k)) || ':' || k || '13:o_orderstatus' || octet_length(encode(s)) || ':' || s)"
_HASHED = f"h AS (SELECT o_orderkey, {_ROW} AS h FROM (SELECT o_orderkey, 'integer:' || o_orderkey AS k, 'string:' || o_orderstatus AS s FROM orders))"


@query(f"WITH {_HASHED} SELECT count(*) AS n_rows, " + ", ".join(f"CAST(sum(CAST('0x' || substr(h, {1 + 8 * i}, 8) AS BIGINT)) AS DECIMAL(38,0)) AS lane{i}" for i in range(LANES)) + " FROM h")
def set_fingerprint_lanes(spark, d):
    return set_lanes(f.table(spark, d, "orders"), ["o_orderkey", "o_orderstatus"])


@query(f"WITH {_HASHED} SELECT o_orderkey, h AS fingerprint FROM h")
def row_fingerprints(spark, d):
    df = f.table(spark, d, "orders")
    return df.select("o_orderkey", row_fingerprint(df, ["o_orderkey", "o_orderstatus"]).alias("fingerprint"))


@query("SELECT sha256(text) AS sha256, count(*) AS n, CAST(sum(octet_length(encode(text))) AS BIGINT) AS n_bytes FROM documents GROUP BY 1")
def content_hash(spark, d):
    docs = f.table(spark, d, "documents").select(F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("bigint").alias("size"))
    return docs.groupBy("sha256").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("n_bytes"))


_CUSTOMER = (("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"), ("c_acctbal", "double"), ("c_mktsegment", "string"))


@query(" UNION ALL ".join(f"SELECT 'customer' AS dataset, '{c}' AS field, '{t}' AS type, TRUE AS nullable, {i} AS ordinal, count(*) AS n_rows, count(*) FILTER ({c} IS NULL) AS n_null, {f"count(*) FILTER ({c} = '')" if t == 'string' else "CAST(0 AS BIGINT)"} AS n_empty FROM customer" for i, (c, t) in enumerate(_CUSTOMER)))
def profile_columns(spark, d):
    return profile.profile(f.table(spark, d, "customer"), "customer")


@query("SELECT 'customer' AS dataset, * FROM (VALUES ('c_name', 'removed', 'string', NULL), ('c_label', 'added', NULL, 'string'), ('c_nationkey', 'retyped', 'int', 'bigint')) x(field, change, was, now)")
def schema_drift(spark, d):
    df = f.table(spark, d, "customer")
    after = df.withColumnRenamed("c_name", "c_label").withColumn("c_nationkey", F.col("c_nationkey").cast("bigint"))
    return profile.drift(profile.profile(df, "customer"), profile.profile(after, "customer"))


def _both(spark, d):
    return f.findings(spark, d, "before"), f.findings(spark, d, "after")


_DELTA = """k AS (SELECT before.check_id, before.code, before.dataset, before.stable_key FROM before JOIN after USING (check_id, code, dataset, stable_key)),
lb AS (SELECT *, row_number() OVER (PARTITION BY check_id, code, dataset ORDER BY stable_key) AS rn FROM before WHERE (check_id, code, dataset, stable_key) NOT IN (SELECT (check_id, code, dataset, stable_key) FROM k)),
la AS (SELECT *, row_number() OVER (PARTITION BY check_id, code, dataset ORDER BY stable_key) AS rn FROM after WHERE (check_id, code, dataset, stable_key) NOT IN (SELECT (check_id, code, dataset, stable_key) FROM k)),
dl AS (SELECT check_id, code, dataset, stable_key, 'persisting' AS change FROM k UNION ALL
SELECT check_id, code, dataset, coalesce(la.stable_key, lb.stable_key), CASE WHEN lb.stable_key IS NULL THEN 'added' WHEN la.stable_key IS NULL THEN 'resolved' ELSE 'changed' END FROM lb FULL JOIN la USING (check_id, code, dataset, rn))"""


@query(f"WITH {f.FINDINGS}, {_DELTA} SELECT check_id, code, dataset, stable_key, change FROM dl")
def run_delta(spark, d):
    return runs.run_delta(*_both(spark, d))


@query(f"WITH {f.FINDINGS}, {_DELTA} SELECT " + ", ".join(f"count(*) FILTER (change = '{k}') AS n_{k}" for k in ("persisting", "changed", "resolved", "added")) + ", count(*) FILTER (change <> 'persisting') = 0 AS equivalent, 'regressed' AS class FROM dl")
def baseline_class(spark, d):
    return runs.baseline_class(runs.delta_summary(runs.run_delta(*_both(spark, d))), True, False)


def _notes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("c1", "k1", "orders", "known"), ("c2", "k0", "orders", "agreed"), ("c9", "k0", "orders", "stale")], "check_id string, code string, dataset string, reason string")


@query(f"WITH {f.FINDINGS} SELECT stable_key, CASE WHEN result = 'fail' THEN CASE WHEN check_id = 'c1' AND code = 'k1' THEN 'known' WHEN check_id = 'c2' AND code = 'k0' THEN 'agreed' END END AS expected_reason FROM before")
def exception_annotation(spark, d):
    return runs.annotate(f.findings(spark, d, "before"), _notes(spark)).select("stable_key", "expected_reason")


@query(f"WITH {f.FINDINGS}, sec(code, section) AS (VALUES ('k0', 'rows'), ('k1', 'rows'), ('k1', 'amounts'), ('k2', 'amounts')) SELECT section, count(*) FILTER (result = 'pass') AS n_pass, count(*) FILTER (result = 'fail') AS n_fail, count(*) FILTER (result = 'warning') AS n_warning FROM before JOIN sec USING (code) GROUP BY 1")
def scorecard(spark, d):
    sections = spark.createDataFrame([("k0", "rows"), ("k1", "rows"), ("k1", "amounts"), ("k2", "amounts")], "code string, section string")
    return runs.scorecard(f.findings(spark, d, "before"), sections)


@query(f"WITH {f.FINDINGS} SELECT count(DISTINCT check_id) FILTER (result = 'fail' AND severity IN ('critical', 'error')) AS n_failed_checks, count(DISTINCT check_id) FILTER (result = 'warning' OR result = 'fail' AND severity = 'info') AS n_warning_checks, CASE WHEN n_failed_checks > 0 THEN 'failed' WHEN n_warning_checks > 0 THEN 'passed_with_warnings' ELSE 'passed' END AS outcome FROM before")
def outcome(spark, d):
    return runs.outcome(f.findings(spark, d, "before"))


@query(f"WITH {f.FINDINGS} SELECT CASE code WHEN 'k0' THEN 'rows' ELSE 'amounts' END AS category, count(*) AS n FROM before WHERE result = 'fail' AND code <> 'k2' GROUP BY 1")
def discrepancy_count(spark, d):
    return runs.discrepancies(f.findings(spark, d, "before"), spark.createDataFrame([("k0", "rows"), ("k1", "amounts")], "code string, category string"))


@query(f"WITH {f.FINDINGS}, x AS (SELECT check_id, code, count(*) AS n FROM before WHERE result = 'fail' GROUP BY ALL), y AS (SELECT check_id, code, count(*) AS n FROM after WHERE result = 'fail' GROUP BY ALL) SELECT check_id, code, coalesce(x.n, 0) AS n_before, coalesce(y.n, 0) AS n_after, greatest(n_before - n_after, 0) AS n_resolved, greatest(n_after - n_before, 0) AS n_introduced FROM x FULL JOIN y USING (check_id, code)")
def group_delta(spark, d):
    return runs.group_delta(*_both(spark, d))


@query(f"WITH {f.FINDINGS}, x AS (SELECT check_id, code, count(*) AS n FROM before GROUP BY ALL), y AS (SELECT check_id, code, count(*) AS n FROM after GROUP BY ALL) SELECT check_id, code, coalesce(x.n, 0) AS n_before, coalesce(y.n, 0) AS n_after, least(n_before, n_after) AS persisting, greatest(n_before - n_after, 0) AS resolved, greatest(n_after - n_before, 0) AS added FROM x FULL JOIN y USING (check_id, code)")
def bag_difference(spark, d):
    return reconcile.bag_difference(*_both(spark, d), ["check_id", "code"])


@query("SELECT CAST(user_id AS VARCHAR) AS run_id, epoch_us(max(ts)) AS started, TRUE AS valid FROM events GROUP BY 1")
def run_history(spark, d):
    seen = f.table(spark, d, "events").groupBy(F.col("user_id").cast("string").alias("run_id")).agg(F.max("ts").cast("timestamp").alias("started_at"))
    return runs.run_history(seen).select("run_id", F.unix_micros("started_at").alias("started"), "valid")


@query(f"""WITH {f.JOURNAL}, x AS (SELECT target_key, 'class' || (CAST(substr(target_key, 2) AS BIGINT) % 3) AS semantic_type, unnest(edges) AS edge FROM l), y AS (SELECT target_key, semantic_type, bool_and(edge = 'copy_open') AS ok, bool_or(edge = 'archive_closed') AS lost FROM x GROUP BY ALL)
SELECT semantic_type, count(*) AS n_affected, count(*) FILTER (ok) AS n_recoverable, count(*) FILTER (NOT ok AND lost) AS n_irrecoverable, count(*) FILTER (NOT ok AND NOT lost) AS n_unknown, round(CAST(100.0 * count(*) FILTER (ok) AS DOUBLE) / count(*), 4) AS percent FROM y GROUP BY 1""")
def coverage_by_type(spark, d):
    lined = accounting.lineage(*_booked(spark, d)).withColumn("semantic_type", F.concat(F.lit("class"), F.substring("target_key", 2, 20).cast("bigint") % 3))
    edges = spark.createDataFrame([("copy_open", True), ("archive_closed", False), ("map_pending", None)], "edge string, recoverable boolean")
    return runs.recovery_coverage(lined, edges).withColumn("percent", F.col("percent").cast("double"))


@query("SELECT p_brand, p_size, count(DISTINCT p_type) AS n FROM part GROUP BY ALL HAVING n > 1")
def reversibility(spark, d):
    return runs.irreversible(f.table(spark, d, "part"), ["p_type"], ["p_brand", "p_size"])


@query(f"WITH {f.ORDERS} SELECT count(*) FILTER (side = 'e') AS n_left_only, count(*) FILTER (side = 'a') AS n_right_only, count(*) = 0 AS equal FROM (SELECT 'e' AS side, o_orderkey FROM e WHERE o_orderkey NOT IN (SELECT o_orderkey FROM a) UNION SELECT 'a', o_orderkey FROM a WHERE o_orderkey NOT IN (SELECT o_orderkey FROM e))")
def set_equality(spark, d):
    return reconcile.set_equal(*sides(spark, d), KEY)


@query(f"WITH {f.ORDERS} SELECT side, count(*) AS n FROM (SELECT 'lost' AS side, * FROM (SELECT * FROM e EXCEPT ALL SELECT * FROM a) UNION ALL SELECT 'added', * FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM e)) GROUP BY 1")
def restore_check(spark, d):
    return runs.restored_differences(*sides(spark, d)).groupBy("side").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {f.ORDERS} SELECT 'orders_there' AS check_id, 'missing' AS code, count(*) AS n FROM e WHERE o_orderkey NOT IN (SELECT o_orderkey FROM a) UNION ALL SELECT 'orders_explained', 'unexpected', count(*) FROM a WHERE o_orderkey NOT IN (SELECT o_orderkey FROM e)
UNION ALL SELECT 'orders_values', 'value', count(*) FROM ({" UNION ALL ".join(map(_differ, FIELDS))}) UNION ALL SELECT 'orders_once', 'repeated', count(*) FROM (SELECT o_orderkey FROM a GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'orders_total', 'total', 1""")
def verification(spark, d):
    return runs.by_check(flagship(spark, d))


@query(f"WITH {f.FINDINGS} SELECT 'c9' AS check_id, 'k0' AS code, 'orders' AS dataset, 'stale' AS reason FROM (SELECT 1) WHERE NOT EXISTS (SELECT 1 FROM before WHERE check_id = 'c9')")
def annotation_unmatched(spark, d):
    return runs.unmatched_annotations(f.findings(spark, d, "before"), _notes(spark))


@query("SELECT o_orderkey, CAST(1 + o_orderkey % 3 AS INTEGER) AS kind, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_totalprice AS DECIMAL(38,6)) END AS number, CASE WHEN o_orderkey % 3 = 1 THEN CAST(o_orderdate AS DATE) END AS day FROM orders")
def typed_order(spark, d):
    k = F.col("o_orderkey")
    mixed = F.when(k % 3 == 0, F.col("o_totalprice").cast(f.MONEY).cast("string")).when(k % 3 == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.col("o_orderpriority"))
    return f.table(spark, d, "orders").select(k, C.typed_order(mixed).alias("v")).orderBy("v", "o_orderkey").select("o_orderkey", "v.kind", "v.number", "v.day")


@query(f"""WITH {f.FINDINGS}, {f.JOURNAL}, p AS ({_DISPOSED}) SELECT 'result' AS section, result AS item, count(*) AS n FROM before GROUP BY 2 UNION ALL SELECT 'failed', check_id || '/' || code, count(*) FROM before WHERE result = 'fail' GROUP BY 2
UNION ALL SELECT 'coverage', 'disposition_missing', 0 UNION ALL SELECT 'coverage', 'disposition_unexpected', 0 UNION ALL SELECT 'coverage', 'disposition_unaccounted', count(*) FROM p WHERE disposition = 'unaccounted' UNION ALL SELECT 'coverage', 'lineage_missing', count(*) FROM t WHERE target_key NOT IN (SELECT target_key FROM l)
UNION ALL SELECT 'coverage', 'lineage_unexpected', count(*) FROM l WHERE target_key NOT IN (SELECT target_key FROM t) UNION ALL SELECT 'coverage', 'lineage_unbound', 0""")
def verification_report(spark, d):
    return runs.report(f.findings(spark, d, "before"), coverage_summary(spark, d))


@query("SELECT c_custkey, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_mktsegment FROM customer")
def normalised_types(spark, d):
    return readers.normalised(f.table(spark, d, "customer")).select("c_custkey", "c_nationkey", "c_mktsegment")


@query("SELECT 'part' AS field, CASE WHEN count(*) = 0 THEN 'empty' ELSE 'string' END AS inferred, count(*) AS n FROM part UNION ALL SELECT 'size', 'integer', count(*) FROM part UNION ALL SELECT 'price', 'decimal', count(*) FROM part")
def inferred_types(spark, d):
    text = f.table(spark, d, "part").select(F.col("p_name").alias("part"), F.col("p_size").cast("string").alias("size"), F.concat(F.col("p_retailprice").cast(f.MONEY).cast("string")).alias("price"))
    return profile.inferred_types(text, ["part", "size", "price"])


def _len(c: str) -> str:
    """A key part as findings name it: its length before it."""
    return f"octet_length(encode(CAST({c} AS VARCHAR))) || ':' || {c}"


@query(f"""WITH {f.JOURNAL}, u AS (SELECT f.* FROM f JOIN orders ON source_key = CAST(o_orderkey AS VARCHAR) WHERE o_orderpriority = '1-URGENT')
SELECT * FROM (SELECT source_key AS key, CASE WHEN (p > 0 AND x > 0) OR (fl > 0 AND (p > 0 OR x > 0)) THEN 'conflict' WHEN fl > 0 THEN 'failed' WHEN p = 0 AND x = 0 THEN 'unaccounted' END AS code FROM u) WHERE code IS NOT NULL
UNION ALL SELECT '', 'no_sources' WHERE NOT EXISTS (SELECT 1 FROM u)""")
def accounting_of_a_type(spark, d):
    urgent = f.table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").cast("string").alias("source_key"))
    return CHECKS["accounting"](Context({}, {}, sources=urgent, journal=f.journal(spark, d)))


def _members(spark, d):
    k = F.col("c_custkey")
    e = f.table(spark, d, "customer").select(k, "c_name", "c_mktsegment")
    a = e.where(k % 41 != 0).withColumns({"c_mktsegment": F.when(k % 37 == 0, F.lit(None)).otherwise(F.col("c_mktsegment")), "c_name": F.when(k % 43 == 0, F.lower("c_name")).otherwise(F.col("c_name"))})
    return Context({"members": e}, {"members": a})


@query(f"""SELECT {_len('c_custkey')} || '/c_mktsegment' AS key, 'value' AS code, c_mktsegment AS expected, NULL AS actual, 'c_mktsegment' AS detail FROM customer WHERE c_custkey % 41 <> 0 AND c_custkey % 37 = 0 AND c_mktsegment IS NOT NULL
UNION ALL SELECT {_len('c_custkey')} || '/c_name', 'value', c_name, lower(c_name), 'c_name' FROM customer WHERE c_custkey % 41 <> 0 AND c_custkey % 43 = 0 AND c_name <> lower(c_name)""")
def member_values(spark, d):
    return CHECKS["values"](_members(spark, d), "members", ["c_custkey"], ["c_name", "c_mktsegment"])


@query(f"SELECT {_len('c_custkey')} AS key, 'missing' AS code FROM customer WHERE c_custkey % 41 = 0 UNION ALL SELECT '', 'nothing_expected' WHERE NOT EXISTS (SELECT 1 FROM customer)")
def member_presence(spark, d):
    return CHECKS["presence"](_members(spark, d), "members", ["c_custkey"])


_STATUS = {"O": "open", "F": "closed", "P": "pending"}
_RECODED = f"{f.ORDERS}, m AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'closed' WHEN 'P' THEN 'pending' END AS code_ FROM e), r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'open' ELSE CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'closed' WHEN 'P' THEN 'pending' ELSE 'other' END END AS code_ FROM a)"


def _recoded(spark, d) -> Context:
    e, a = sides(spark, d)
    codes = F.when(F.col("o_orderkey") % 7 == 0, "open").otherwise(C.code_map(F.col("o_orderstatus"), _STATUS, "default", "other"))
    return Context({"orders": e}, {"orders": a.withColumn("o_orderstatus", codes)})


@query(f"WITH {_RECODED} SELECT {_len('m.o_orderkey')} || '/o_orderstatus' AS key, 'value' AS code, m.code_ AS expected, r.code_ AS actual, 'o_orderstatus' AS detail FROM m JOIN r USING (o_orderkey) JOIN once USING (o_orderkey) WHERE m.code_ IS DISTINCT FROM r.code_")
def member_status(spark, d):
    return CHECKS["values"](_recoded(spark, d), "orders", KEY, ["o_orderstatus"], maps={"o_orderstatus": _STATUS})


@query(f"""WITH {_RECODED}, g AS (SELECT o_orderkey, count(*) AS n, min(code_) AS code_ FROM r GROUP BY 1)
SELECT * FROM (SELECT {_len('m.o_orderkey')} AS key, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'repeated' WHEN m.code_ IS DISTINCT FROM g.code_ THEN 'fields' END AS code FROM m LEFT JOIN g USING (o_orderkey)) WHERE code IS NOT NULL""")
def code_transformation(spark, d):
    return CHECKS["exactly_one"](_recoded(spark, d), "orders", KEY, ["o_orderstatus"], maps={"o_orderstatus": _STATUS})


@query(f"""WITH {_STATES}, x AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY date) AS rn FROM ch), y AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY date) AS rn FROM ch WHERE epoch_us(date) % 23 <> 0)
SELECT * FROM (SELECT {_len('user_id')} || '/' || rn AS key, CASE WHEN y.date IS NULL THEN 'missing' WHEN x.date IS NULL THEN 'extra' WHEN x.date <> y.date THEN 'date' WHEN x.code <> y.code THEN 'code' END AS code FROM x FULL JOIN y USING (user_id, rn)) WHERE code IS NOT NULL""")
def member_timeline(spark, d):
    e = _changes(spark, d)
    a = e.where(F.unix_micros(F.col("date").cast("timestamp")) % 23 != 0)
    return CHECKS["event_positions"](Context({"events": e}, {"events": a}), "events", "user_id", ["date"], "date", "code")


@query(f"""WITH {_SPANS}, w AS (SELECT *, lag(end_) OVER o AS was, lag(end_ IS NULL) OVER o AS open_ FROM v WHERE start_ IS NOT NULL AND (end_ IS NULL OR end_ >= start_) WINDOW o AS (PARTITION BY o_custkey ORDER BY start_, o_orderkey))
SELECT * FROM (SELECT o_custkey, o_orderkey, CASE WHEN start_ IS NULL THEN 'no_start' WHEN end_ < start_ THEN 'reversed' END AS code FROM v UNION ALL
SELECT o_custkey, o_orderkey, CASE WHEN open_ THEN 'after_open' WHEN start_ <= was THEN 'overlap' WHEN start_ - was > 1 THEN 'gap' END FROM w) WHERE code IS NOT NULL""")
def valid_periods(spark, d):
    return timelines.interval_faults(_spans(spark, d), "o_custkey", "start_", "end_", "o_orderkey", continuous=True, skip_invalid=True)


_DOCUMENTS = """de AS (SELECT doc_id, source, sha256(text) AS hash FROM documents),
da0 AS (SELECT doc_id, CASE WHEN doc_id % 29 = 0 THEN source || 'x' ELSE source END AS source, CASE WHEN doc_id % 19 = 0 THEN 'gone' WHEN doc_id % 2 = 0 THEN upper(hash) ELSE hash END AS hash FROM de WHERE doc_id % 17 <> 0),
da AS (SELECT * FROM da0 UNION ALL SELECT * FROM da0 WHERE doc_id % 23 = 0)"""


def _documents(spark, d) -> Context:
    k = F.col("doc_id")
    e = f.table(spark, d, "documents").select(k, "source", F.sha2("text", 256).alias("hash"))
    a = e.where(k % 17 != 0).withColumns({"source": F.when(k % 29 == 0, F.concat("source", F.lit("x"))).otherwise(F.col("source")), "hash": F.when(k % 19 == 0, "gone").when(k % 2 == 0, F.upper("hash")).otherwise(F.col("hash"))})
    a = a.withColumn("_copy", F.explode(F.when(k % 23 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("_copy")
    return Context({"documents": e}, {"documents": a, "sources": f.table(spark, d, "documents").where("doc_id % 3 = 0 AND source <> 'src1'").select("source").distinct()})


@query(f"""WITH {_DOCUMENTS}, g AS (SELECT doc_id, count(*) AS n, min(lower(hash)) AS h FROM da GROUP BY 1), x AS (SELECT {_len('de.doc_id')} AS key, n, coalesce(lower(de.hash) = h, FALSE) AS same FROM de LEFT JOIN g USING (doc_id))
SELECT key, 'missing' AS code FROM x WHERE n IS NULL UNION ALL SELECT key, 'repeated' FROM x WHERE n > 1 UNION ALL SELECT key, 'content' FROM x WHERE n IS NOT NULL AND NOT same""")
def document_accounting(spark, d):
    return CHECKS["digests"](_documents(spark, d), "documents", ["doc_id"], "hash")


@query(f"""WITH {_DOCUMENTS}, known AS (SELECT DISTINCT source AS own FROM documents WHERE doc_id % 3 = 0 AND source <> 'src1'), g AS (SELECT doc_id, count(*) AS n, min(source) AS own FROM da GROUP BY 1),
x AS (SELECT {_len('de.doc_id')} AS k, n, de.source IS DISTINCT FROM g.own AS other, g.own NOT IN (SELECT own FROM known WHERE own IS NOT NULL) OR g.own IS NULL AS orphan FROM de LEFT JOIN g USING (doc_id))
SELECT k || '/missing' AS key, 'missing' AS code FROM x WHERE n IS NULL UNION ALL SELECT k || '/repeated', 'repeated' FROM x WHERE n > 1 UNION ALL SELECT k || '/owner', 'owner' FROM x WHERE n IS NOT NULL AND other UNION ALL SELECT k || '/orphan', 'orphan' FROM x WHERE n IS NOT NULL AND orphan""")
def document_owner(spark, d):
    return CHECKS["owners"](_documents(spark, d), "documents", ["doc_id"], "source", "sources", "source")


_AT = "strftime(ts, '%Y-%m-%dT%H:%M:%S')"


def _instants(spark, d):
    return f.table(spark, d, "events").select("event_id", "ts", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("at"))


@query(f"""WITH x AS (SELECT event_id, {_AT} || 'Z' AS expected, {_AT} || CASE WHEN event_id % 37 = 0 THEN '' WHEN event_id % 31 = 0 THEN '+00:00' ELSE 'Z' END AS actual FROM events)
SELECT {_len('event_id')} AS key, CASE WHEN event_id % 37 = 0 THEN 'no_offset' ELSE 'text' END AS code, expected, actual FROM x WHERE expected <> actual""")
def instant_text(spark, d):
    k, rows = F.col("event_id"), _instants(spark, d)
    zone = F.when(k % 37 == 0, "").when(k % 31 == 0, "+00:00").otherwise("Z")
    ctx = Context({"events": rows.withColumn("at", F.concat("at", F.lit("Z")))}, {"events": rows.withColumn("at", F.concat(F.col("at"), zone))})
    return CHECKS["same_instant_text"](ctx, "events", ["event_id"], "at")


@query("SELECT event_id, event_id % 5 = 0 AS has_offset, CASE WHEN event_id % 5 <> 4 THEN epoch_us(date_trunc('second', ts)) - CASE WHEN event_id % 5 = 0 THEN 7200000000 ELSE 0 END END AS micros FROM events")
def timestamp_kinds(spark, d):
    k = F.col("event_id")
    text = F.when(k % 5 == 4, "no time").when(k % 5 == 0, F.concat("at", F.lit("+02:00"))).otherwise(F.col("at"))
    return _instants(spark, d).select("event_id", C.timestamp_kind(text).alias("t")).select("event_id", "t.has_offset", "t.micros")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 2 THEN CAST(o_orderdate AS DATE) END AS day FROM orders")
def dates_of_text(spark, d):
    k, day = F.col("o_orderkey"), lambda p: F.date_format("o_orderdate", p)
    text = F.when(k % 4 == 0, day("yyyy-MM-dd")).when(k % 4 == 1, day("yyyyMMdd")).when(k % 4 == 2, day("dd.MM.yyyy")).otherwise("1997-02-31")
    return f.table(spark, d, "orders").select("o_orderkey", C.as_date(text).alias("day"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN CAST(o_totalprice AS DECIMAL(18,2)) END::DECIMAL(38,2) AS price FROM orders")
def exact_decimals(spark, d):
    k, price = F.col("o_orderkey"), F.col("o_totalprice").cast(f.MONEY).cast("string")
    text = F.concat(price, F.when(k % 3 == 0, "").when(k % 3 == 1, "000").otherwise("5"))
    return f.table(spark, d, "orders").select("o_orderkey", C.exact_decimal(text, 2).alias("price"))


@query(f"SELECT o_orderkey, sha256('5:sales4:main5:order' || {_len('o_orderkey')}) AS artifact_id FROM orders")
def artifact_ids(spark, d):
    return f.table(spark, d, "orders").select("o_orderkey", C.digest(F.lit("sales"), F.lit("main"), F.lit("order"), F.col("o_orderkey")).alias("artifact_id"))


@query(f"SELECT l_orderkey, l_linenumber, {_len('l_orderkey')} || {_len('l_linenumber')} AS key FROM lineitem")
def composite_keys(spark, d):
    return f.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", C.prefixed(F.col("l_orderkey"), F.col("l_linenumber")).alias("key"))


@query(f"WITH {f.FINDINGS} SELECT stable_key, check_id, sha256(run_id || chr(31) || check_id || chr(31) || stable_key) AS evidence_id FROM before")
def evidence_ids(spark, d):
    found = f.findings(spark, d, "before")
    return found.select("stable_key", "check_id", C.evidence_id(F.col("run_id"), F.col("check_id"), F.col("stable_key")).alias("evidence_id"))


@query(f"WITH {_DOCUMENTS} SELECT de.doc_id, CASE WHEN de.doc_id % 13 = 0 THEN FALSE ELSE coalesce(lower(de.hash) = lower(da0.hash), FALSE) END AS same FROM de JOIN da0 USING (doc_id)")
def digest_equality(spark, d):
    ctx = _documents(spark, d)
    e = ctx.expected["documents"].select("doc_id", F.when(F.col("doc_id") % 13 == 0, "").otherwise(F.col("hash")).alias("e"))
    return e.join(ctx.actual["documents"].distinct().select("doc_id", F.col("hash").alias("a")), "doc_id").select("doc_id", C.same_digest(F.col("e"), F.col("a")).alias("same"))


@query("SELECT doc_id, source = 'src1' AS in_folder, lang = 'en' AS in_any, doc_id BETWEEN 10 AND 99 AS two_digits FROM documents")
def glob_match(spark, d):
    path = F.concat_ws("/", "source", "lang", F.concat("doc_id", F.lit(".txt")))
    globs = {"in_folder": "src1/**", "in_any": "**/en/*.txt", "two_digits": "*/*/??.txt"}
    return f.table(spark, d, "documents").select("doc_id", *[path.rlike(C.glob_regex(g)).alias(n) for n, g in globs.items()])


@query(f"WITH {f.JOURNAL} SELECT s.source_key, count(target_key) AS n_produced, CAST(count(DISTINCT target_key) AS INTEGER) AS n_targets FROM s LEFT JOIN (SELECT * FROM j WHERE result = 'produced' UNION ALL SELECT * FROM j WHERE result = 'produced' AND edge = 'map_pending') x USING (source_key) GROUP BY 1")
def implied_accounting(spark, d):
    made = f.journal(spark, d).where("result = 'produced'").select("edge", "source_key", "target_key")
    twice = made.unionByName(made.where("edge = 'map_pending'"))
    return accounting.source_facts(f.sources(spark, d), accounting.journal_of(twice)).select("source_key", "n_produced", F.size("targets").alias("n_targets"))


@query(f"WITH {f.ORDERS}, x AS (SELECT CASE WHEN o_orderkey % 113 <> 0 THEN o_orderkey END AS o_orderkey, o_custkey FROM a) SELECT o_orderkey, o_custkey, count(*) AS n, CASE WHEN o_orderkey IS NULL THEN 'null' ELSE 'repeated' END AS code FROM x GROUP BY 1, 2 HAVING count(*) > 1 OR o_orderkey IS NULL")
def identity_faults(spark, d):
    a = f.actual_orders(spark, d).withColumn("o_orderkey", F.when(F.col("o_orderkey") % 113 != 0, F.col("o_orderkey")))
    return readers.bad_keys(a, ["o_orderkey", "o_custkey"])


@query(f"WITH {f.ORDERS} SELECT 'status' AS check_id, 'sha256:' || sha256(e.o_orderstatus) AS expected, 'sha256:' || sha256(a.o_orderstatus) AS actual FROM e JOIN a USING (o_orderkey) JOIN once USING (o_orderkey) WHERE e.o_orderstatus <> a.o_orderstatus")
def findings_redacted(spark, d):
    e, a = sides(spark, d)
    found = verify(Context({"orders": e}, {"orders": a}, redact=True), [Check("status", "values", {"dataset": "orders", "keys": KEY, "fields": ["o_orderstatus"]})])
    return found.where("code = 'value'").select("check_id", "expected", "actual")


@query(f"""WITH {f.ORDERS}, eu AS (SELECT * FROM e WHERE o_orderpriority = '1-URGENT'), au AS (SELECT * FROM a WHERE o_orderpriority = '1-URGENT')
SELECT 'there' AS check_id, 'urgent' AS scope, {_len('o_orderkey')} AS key, 'missing' AS code FROM eu WHERE o_orderkey NOT IN (SELECT o_orderkey FROM au)
UNION ALL SELECT 'once', 'urgent', {_len('o_orderkey')}, 'repeated' FROM au GROUP BY o_orderkey HAVING count(*) > 1 UNION ALL SELECT 'explained', 'full', {_len('o_orderkey')}, 'unexpected' FROM a WHERE o_orderkey NOT IN (SELECT o_orderkey FROM e)""")
def scoped_checks(spark, d):
    """Two checks of a part of orders, and one of all of them."""
    e, a = sides(spark, d)
    urgent, common = Scope("urgent", (Predicate("equals", "o_orderpriority", ("1-URGENT",)),)), {"dataset": "orders", "keys": KEY}
    checks = [Check("there", "presence", common, only=urgent), Check("once", "uniqueness", common, only=urgent), Check("explained", "no_unexpected", common)]
    found = verify(Context({"orders": e}, {"orders": a}), checks)
    key = C.prefixed(F.col("o_orderkey"))
    ids = {c: F.sha2(F.concat_ws("\x1f", F.lit(c), F.lit(code), key), 256) for c, code in (("there", "missing"), ("once", "repeated"), ("explained", "unexpected"))}
    names = e.unionByName(a).select(key.alias("key"), F.explode(F.array(*ids.values())).alias("stable_key")).distinct()
    return found.join(names, "stable_key").select("check_id", "scope", "key", "code")


def queries() -> dict[str, Query]:
    return QUERIES | stored.QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL | stored.SQL

"""The two sides that the catalogue's queries compare, derived from the driver's tables by fixed rules, as frames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def expected_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.col("o_totalprice").cast(MONEY).alias("price"), F.col("o_orderdate").cast("date").alias("order_date"), "o_orderpriority")


def actual_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some orders are gone, some twice, some have another status or price, some are new."""
    k = F.col("o_orderkey")
    base = expected_orders(spark, sf_dir).where(k % 97 != 0).withColumns({
        "o_orderstatus": F.when(k % 89 == 0, "X").otherwise(F.col("o_orderstatus")),
        "price": F.when(k % 83 == 0, F.col("price") + F.lit("0.02").cast(MONEY)).otherwise(F.col("price")).cast(MONEY),
    })
    # one scan: each row turns into one to three
    copies = F.filter(F.array(k, F.when(k % 101 == 0, k), F.when(k % 103 == 0, k + 10_000_000)), lambda x: x.isNotNull())
    return base.withColumn("o_orderkey", F.explode(copies))


ORDERS = """
e AS (SELECT o_orderkey, o_custkey, o_orderstatus, CAST(o_totalprice AS DECIMAL(18,2)) AS price, CAST(o_orderdate AS DATE) AS order_date, o_orderpriority FROM orders),
b AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 89 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
  CAST(CASE WHEN o_orderkey % 83 = 0 THEN price + CAST(0.02 AS DECIMAL(18,2)) ELSE price END AS DECIMAL(18,2)) AS price, order_date, o_orderpriority FROM e WHERE o_orderkey % 97 <> 0),
a AS (SELECT * FROM b UNION ALL SELECT * FROM b WHERE o_orderkey % 101 = 0 UNION ALL SELECT * REPLACE (o_orderkey + 10000000 AS o_orderkey) FROM b WHERE o_orderkey % 103 = 0),
once AS (SELECT o_orderkey FROM a GROUP BY 1 HAVING count(*) = 1)"""


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("source_key"))


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    named = F.filter(F.array(F.when(k % 97 != 0, F.concat(F.lit("T"), k)), F.when(k % 103 == 0, F.concat(F.lit("X"), k))), lambda x: x.isNotNull())
    return table(spark, sf_dir, "orders").select(F.explode(named).alias("target_key"))


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    edge = F.when(F.col("o_orderstatus") == "F", "archive_closed").when(F.col("o_orderstatus") == "P", "map_pending").otherwise("copy_open")
    fate = F.when(k % 109 == 0, "failed").when(k % 107 == 0, "excluded").otherwise("produced")
    entries = F.filter(F.array(F.struct(fate.alias("result")), F.when(k % 127 == 0, F.struct(F.lit("excluded").alias("result")))), lambda x: x.isNotNull())
    rows = table(spark, sf_dir, "orders").where(k % 113 != 0).select(edge.alias("edge"), k.cast("string").alias("source_key"), F.explode(entries).alias("x"))
    return rows.select("edge", "x.result", "source_key", F.when(F.col("x.result") == "produced", F.concat(F.lit("T"), F.col("source_key"))).alias("target_key"))


OPERATIONS = {"archive_closed": "archive", "map_pending": "map", "copy_open": "copy"}

JOURNAL = """
s AS (SELECT CAST(o_orderkey AS VARCHAR) AS source_key FROM orders),
t AS (SELECT 'T' || o_orderkey AS target_key FROM orders WHERE o_orderkey % 97 <> 0 UNION ALL SELECT 'X' || o_orderkey FROM orders WHERE o_orderkey % 103 = 0),
j0 AS (SELECT CASE o_orderstatus WHEN 'F' THEN 'archive_closed' WHEN 'P' THEN 'map_pending' ELSE 'copy_open' END AS edge,
  CASE WHEN o_orderkey % 109 = 0 THEN 'failed' WHEN o_orderkey % 107 = 0 THEN 'excluded' ELSE 'produced' END AS result, CAST(o_orderkey AS VARCHAR) AS source_key, o_orderkey AS k FROM orders WHERE o_orderkey % 113 <> 0),
j AS (SELECT edge, result, source_key, CASE WHEN result = 'produced' THEN 'T' || source_key END AS target_key FROM j0
  UNION ALL SELECT edge, 'excluded', source_key, NULL FROM j0 WHERE k % 127 = 0),
f AS (SELECT s.source_key, count(*) FILTER (result = 'produced') AS p, count(*) FILTER (result = 'excluded') AS x, count(*) FILTER (result = 'failed') AS fl,
  list_sort(list_distinct(coalesce(list(target_key) FILTER (target_key IS NOT NULL), []))) AS targets, list_sort(list_distinct(coalesce(list(edge) FILTER (edge IS NOT NULL), []))) AS edges
  FROM s LEFT JOIN j ON s.source_key = j.source_key GROUP BY 1),
l AS (SELECT target_key, list_sort(list_distinct(list(j.source_key))) AS sources, list_sort(list_distinct(list(edge))) AS edges FROM j JOIN s ON j.source_key = s.source_key WHERE result = 'produced' GROUP BY 1)"""


def findings(spark: SparkSession, sf_dir: str, run: str) -> DataFrame:
    """Findings of a run, a row an order: some differ between the runs before and after."""
    k, after = F.col("o_orderkey"), run == "after"
    key = F.concat(k.cast("string"), F.when((k % 17 == 0) & F.lit(after), "-2").otherwise(""))
    return table(spark, sf_dir, "orders").where(k % (13 if after else 11) != 0).select(
        F.lit(run).alias("run_id"), F.concat(F.lit("c"), k % 7).alias("check_id"), F.concat(F.lit("k"), k % 3).alias("code"), F.lit("orders").alias("dataset"), key.alias("stable_key"),
        F.when(k % 5 == 0, "pass").when(k % 5 == 1, "warning").otherwise("fail").alias("result"), F.when(k % 4 == 0, "error").when(k % 4 == 1, "critical").otherwise("info").alias("severity"),
    )


def _run(name: str, modulus: int, suffix: str) -> str:
    return f"""{name} AS (SELECT '{name}' AS run_id, 'c' || (o_orderkey % 7) AS check_id, 'k' || (o_orderkey % 3) AS code, 'orders' AS dataset, CAST(o_orderkey AS VARCHAR) || {suffix} AS stable_key,
  CASE o_orderkey % 5 WHEN 0 THEN 'pass' WHEN 1 THEN 'warning' ELSE 'fail' END AS result, CASE o_orderkey % 4 WHEN 0 THEN 'error' WHEN 1 THEN 'critical' ELSE 'info' END AS severity FROM orders WHERE o_orderkey % {modulus} <> 0)"""


FINDINGS = "\n" + _run("before", 11, "''") + ",\n" + _run("after", 13, "CASE WHEN o_orderkey % 17 = 0 THEN '-2' ELSE '' END")

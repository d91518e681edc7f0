"""Named queries whose data goes through a store: written in a format, read back by the library's reader, and stated by SQL over the table itself.

Everything is written below the shared folder, in the layout that the reader is for.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import ordered
from tidemark.functions.canonical import composed
from tidemark.functions.columns import as_text
from tidemark.operators import mergeable, runs
from tidemark.plans import frames as f
from tidemark.shared import shared_folder
from tidemark.sources import capture, evidence, payload_sink, readers, strict_json
from tidemark.sources.strict_json import Property

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def register(q):
        QUERIES[q.__name__], SQL[q.__name__] = q, sql
        return q

    return register


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return f.table(spark, d, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderstatus")).alias("status"), F.col("o_totalprice").cast(f.MONEY).alias("price"), F.col("o_orderdate").cast("date").alias("day"), "o_orderpriority")


_ORDERS = "SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderstatus END AS status, CAST(o_totalprice AS DECIMAL(18,2)) AS price, CAST(o_orderdate AS DATE) AS day, o_orderpriority FROM orders"
_KINDS = {"o_orderkey": "integer", "o_custkey": "integer", "status": "string", "price": "decimal", "day": "date", "o_orderpriority": "string"}


def _typed(df: DataFrame) -> DataFrame:
    return df.select("o_orderkey", "o_custkey", "status", F.col("price").cast(f.MONEY).alias("price"), "day", "o_orderpriority")


@query(_ORDERS)
def csv_round_trip(spark, d):
    at = shared_folder(spark)
    _orders(spark, d).write.option("header", True).csv(at)
    rows = readers.read_csv(spark, at)
    return _typed(rows.select(*[readers.declared(F.col(c), k, scale=2).alias(c) for c, k in _KINDS.items()]))


@query(_ORDERS)
def ndjson_round_trip(spark, d):
    at = shared_folder(spark)
    _orders(spark, d).write.json(at)
    rows, rejects = strict_json.read_ndjson(spark, at, [Property(c, k, scale=2) for c, k in _KINDS.items()])
    return _typed(rows)


@query(_ORDERS)
def json_schema_round_trip(spark, d):
    """One object a line, nested, by a declared schema of exact types."""
    at = shared_folder(spark)
    df = _orders(spark, d)
    df.select("o_orderkey", F.struct("o_custkey", "status", F.struct("price", "day").alias("terms")).alias("body"), "o_orderpriority").write.json(at)
    rows = readers.read_json(spark, at, "o_orderkey bigint, body struct<o_custkey:bigint,status:string,terms:struct<price:decimal(18,2),day:date>>, o_orderpriority string", lines=True)
    return rows.select("o_orderkey", "body.o_custkey", "body.status", "body.terms.price", "body.terms.day", "o_orderpriority")


@query(_ORDERS)
def xml_round_trip(spark, d):
    at = shared_folder(spark)
    _orders(spark, d).write.option("rowTag", "order").xml(at)
    schema = T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("o_custkey", T.LongType()), T.StructField("status", T.StringType()), T.StructField("price", T.DecimalType(18, 2)), T.StructField("day", T.DateType()), T.StructField("o_orderpriority", T.StringType())])
    return readers.read_xml(spark, at, "order", schema)


@query(_ORDERS + " WHERE o_orderkey % 53 <> 0")
def fixed_width_round_trip(spark, d):
    """Numbers and dates in columns; lines that were cut short on the way are rejects."""
    at, widths = shared_folder(spark), {"o_orderkey": 12, "o_custkey": 12, "status": 2, "price": 16, "day": 10, "o_orderpriority": 15}
    df = _orders(spark, d)
    text = lambda c: F.rpad(as_text(F.col(c), df.schema[c].dataType.simpleString()), widths[c], " ")
    line = F.concat(*map(text, widths))
    df.select(F.when(F.col("o_orderkey") % 53 == 0, F.substring(line, 1, 40)).otherwise(line).alias("value")).write.text(at)
    start, fields = 1, []
    for c, w in widths.items():
        fields.append(readers.Field(c, _KINDS[c], start, w, options=(("scale", 2),) if c == "price" else (("null_text", ""),) if c == "status" else ()))
        start += w
    rows, _ = readers.read_fixed_width(spark, at, fields, start - 1)
    return _typed(rows)


@query(_ORDERS)
def parquet_round_trip(spark, d):
    at = shared_folder(spark)
    _orders(spark, d).write.parquet(at)
    df = spark.read.parquet(at)
    readers.guard_flat(df.schema)
    return readers.pick(df, ["o_custkey", "status", "price", "day", "o_orderpriority"], ["o_orderkey"])


_PROPS = """x AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(value AS DECIMAL(18,2)) AS v FROM events)"""


def _records(spark: SparkSession, d: str) -> DataFrame:
    """A JSON text an event, some with a property twice, a number of more digits than are declared, one with an exponent, or a text where a number belongs."""
    e, k = f.table(spark, d, "events"), F.col("event_id")
    value = F.col("value").cast(f.MONEY).cast("string")
    number = F.when(k % 31 == 0, F.concat(value, F.lit("001"))).when(k % 37 == 0, F.concat(value, F.lit("e0"))).when(k % 41 == 0, "true").otherwise(value)
    twice = F.when(k % 29 == 0, F.concat(F.lit(',"props":'), "props")).otherwise("")
    cut = F.when(k % 43 == 0, "").otherwise("}")
    return e.select("event_id", F.concat(F.lit('{"props":'), "props", F.lit(',"amount":'), number, F.lit(',"id":'), k.cast("string"), twice, cut).alias("record"))


_DECLARED = [Property("id", "integer"), Property("k", "integer", "props.k"), Property("amount", "decimal", scale=2)]


@query(f"WITH {_PROPS} SELECT event_id, event_id AS id, k, CAST(v AS DECIMAL(18,2)) AS amount FROM x WHERE event_id % 29 <> 0 AND event_id % 31 <> 0 AND event_id % 37 <> 0 AND event_id % 41 <> 0 AND event_id % 43 <> 0")
def strict_json_rows(spark, d):
    rows, _ = strict_json.parse_records(_records(spark, d), "record", _DECLARED, ["event_id"])
    return rows.withColumn("amount", F.col("amount").cast(f.MONEY))


@query("""SELECT * FROM (SELECT event_id, CASE WHEN event_id % 43 = 0 THEN 'syntax' WHEN event_id % 29 = 0 THEN 'repeated' WHEN event_id % 31 = 0 OR event_id % 37 = 0 OR event_id % 41 = 0 THEN 'kind' END AS code,
  CASE WHEN event_id % 43 <> 0 AND event_id % 29 <> 0 AND (event_id % 31 = 0 OR event_id % 37 = 0 OR event_id % 41 = 0) THEN 'amount' END AS property FROM events) WHERE code IS NOT NULL""")
def strict_json_rejects(spark, d):
    return strict_json.parse_records(_records(spark, d), "record", _DECLARED, ["event_id"])[1]


@query(_ORDERS)
def capture_replay(spark, d):
    """Captured from pinned files, replayed after the fingerprint was found to be the manifest's."""
    at, root = shared_folder(spark), shared_folder(spark)
    _orders(spark, d).write.parquet(at)
    capture.capture_files(spark, at, lambda s, p: s.read.parquet(p), root, "c1", "orders")
    return capture.replay(spark, root, "c1", "orders")


@query(f"WITH {f.FINDINGS} SELECT check_id, code, stable_key, result FROM after")
def ledger_round_trip(spark, d):
    """Two runs in a ledger; writing a run again replaces its rows alone."""
    root = shared_folder(spark)
    capture.write_ledger(root, "r1", findings=f.findings(spark, d, "before"))
    capture.write_ledger(root, "r2", findings=f.findings(spark, d, "before"))
    capture.write_ledger(root, "r2", findings=f.findings(spark, d, "after"))
    return capture.read_ledger(spark, root, "findings", "r2").select("check_id", "code", "stable_key", "result")


@query(f"WITH {f.FINDINGS} SELECT 'finding' AS kind, sha256('r1' || chr(31) || check_id || '/' || code || chr(31) || stable_key) AS evidence_id, check_id, code, result FROM before UNION ALL SELECT 'summary', sha256('r1' || chr(31) || 'summary' || chr(31)), NULL, NULL, NULL")
def evidence_round_trip(spark, d):
    root = shared_folder(spark)
    found = f.findings(spark, d, "before").withColumns({c: F.lit(None).cast("string") for c in ("expected", "actual", "detail")})
    evidence.save(found, root, "r1")
    return evidence.load(spark, root, "r1").select("kind", "evidence_id", "check_id", "code", "result")


@query("SELECT 'd/' || (doc_id % 100) || '/' || doc_id || '.txt' AS relative_path, CAST(octet_length(encode(text)) AS BIGINT) AS length, sha256(text) AS sha256 FROM documents")
def payload_round_trip(spark, d):
    """A file a document; what the list of the run says is what the files hold."""
    root = shared_folder(spark)
    name = F.concat(F.lit("d/"), F.col("doc_id") % 100, F.lit("/"), F.col("doc_id"), F.lit(".txt"))
    payload_sink.write_payloads(f.table(spark, d, "documents").select(name.alias("relative_path"), F.col("text").alias("content")), root, "r1")
    return payload_sink.read_payloads(spark, root, "r1")


def _ranges(e: str) -> str:
    row = f"sha256('10:o_orderkey' || octet_length(encode(k)) || ':' || k || '13:o_orderstatus' || octet_length(encode(s)) || ':' || s)"
    lanes = [f"CAST(sum(CAST('0x' || substr(h, {1 + 8 * i}, 8) AS BIGINT)) AS DECIMAL(38,0))" for i in range(8)]
    return f"(SELECT r AS range, n, sha256(r || ':' || n || ':' || {chr(32).join(f'l{i} || {chr(39)}:{chr(39)} ||' for i in range(7))} l7) AS digest FROM (SELECT r, count(*) AS n, {', '.join(f'{x} AS l{i}' for i, x in enumerate(lanes))} FROM (SELECT '8' || printf('%012x', o_orderkey // 4096) AS r, {row} AS h FROM (SELECT o_orderkey, 'integer:' || o_orderkey AS k, 'string:' || o_orderstatus AS s FROM {e})) GROUP BY 1))"


@query("SELECT * FROM " + _ranges("orders"))
def ordered_ranges(spark, d):
    """The bottom ranges of the ordered fingerprint of orders."""
    return ordered.bottom_ranges(f.table(spark, d, "orders"), ["o_orderkey"], ["o_orderstatus"])


_CHANGED = "(SELECT o_orderkey, CASE WHEN o_orderkey % 9973 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 7919 <> 0)"


@query(f"SELECT b.range, b.n AS n_before, coalesce(a.n, 0) AS n_after FROM {_ranges('orders')} b LEFT JOIN {_ranges(_CHANGED)} a ON a.range = b.range WHERE a.digest IS DISTINCT FROM b.digest")
def divergent_ranges(spark, d):
    df, k = f.table(spark, d, "orders"), F.col("o_orderkey")
    after = df.where(k % 7919 != 0).withColumn("o_orderstatus", F.when(k % 9973 == 0, "X").otherwise(F.col("o_orderstatus")))
    return ordered.divergent_ranges(df, after, ["o_orderkey"], ["o_orderstatus"])


_ROWS = "sha256('10:o_orderkey' || octet_length(encode(k)) || ':' || k || '13:o_orderstatus' || octet_length(encode(s)) || ':' || s)"


def _buckets(e: str) -> str:
    lanes = ", ".join(f"CAST(sum(CAST('0x' || substr(h, {1 + 8 * i}, 8) AS BIGINT)) AS DECIMAL(38,0)) AS l{i}" for i in range(8))
    return f"(SELECT b, count(*) AS n, {lanes} FROM (SELECT substr(sha256(length(CAST(o_orderkey AS VARCHAR)) || ':' || o_orderkey), 1, 3) AS b, {_ROWS} AS h FROM (SELECT o_orderkey, 'integer:' || o_orderkey AS k, 'string:' || o_orderstatus AS s FROM {e})) GROUP BY 1)"


@query(f"SELECT 'orders' AS dataset, x.b AS bucket, x.n AS n_before, coalesce(y.n, 0) AS n_after, CASE WHEN y.b IS NULL THEN 'removed' ELSE 'changed' END AS change FROM {_buckets('orders')} x LEFT JOIN {_buckets(_CHANGED)} y ON x.b = y.b WHERE y.b IS NULL OR " + " OR ".join(f"x.l{i} <> y.l{i}" for i in range(8)))
def changed_inputs(spark, d):
    """The parts of orders that two runs did not read alike."""
    df, k = f.table(spark, d, "orders"), F.col("o_orderkey")
    after = df.where(k % 7919 != 0).withColumn("o_orderstatus", F.when(k % 9973 == 0, "X").otherwise(F.col("o_orderstatus")))
    buckets = lambda x: {"orders": runs.input_buckets(x, ["o_orderkey"], ["o_orderkey", "o_orderstatus"], digits=3)}
    return runs.changed_inputs(buckets(df), buckets(after))


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def composed_texts(spark, d):
    """Documents in which every é, ü and ñ was decomposed have the digest of those in which it was not."""
    text = F.col("text")
    for one, two in (("é", "e\u0301"), ("ü", "u\u0308"), ("ñ", "n\u0303")):
        text = F.replace(text, F.lit(one), F.lit(two))
    docs = f.table(spark, d, "documents").select("doc_id", text.alias("text"))
    return composed(docs, ["text"]).select("doc_id", F.sha2("text", 256).alias("sha256"))


def _bins(t: str) -> str:
    return f"(SELECT o_custkey, b, count(*) AS n FROM (SELECT o_custkey, least(7, greatest(0, CAST(floor(price / 60000) AS INTEGER))) AS b FROM {t}) GROUP BY 1, 2)"


@query(f"""WITH {f.ORDERS}, ea AS (SELECT o_custkey, CAST(sum(n) AS BIGINT) AS ne FROM {_bins('e')} GROUP BY 1), aa AS (SELECT o_custkey, CAST(sum(n) AS BIGINT) AS na FROM {_bins('a')} GROUP BY 1),
c AS (SELECT coalesce(x.o_custkey, y.o_custkey) AS o_custkey, coalesce(x.n, 0) AS e, coalesce(y.n, 0) AS a FROM {_bins('e')} x FULL JOIN {_bins('a')} y ON x.o_custkey = y.o_custkey AND x.b = y.b),
t AS (SELECT o_custkey, coalesce(ne, 0) AS n_expected, coalesce(na, 0) AS n_actual FROM ea FULL JOIN aa USING (o_custkey))
SELECT o_custkey, n_expected, n_actual, CASE WHEN n_expected = 0 OR n_actual = 0 THEN 1.0 ELSE round(CAST((SELECT sum(abs(e * n_actual - a * n_expected)) FROM c WHERE c.o_custkey = t.o_custkey) AS DOUBLE) / (2.0 * n_expected * n_actual), 9) END AS distance FROM t""")
def distribution_drift(spark, d):
    """Each customer's prices on both sides, as histograms merged from partial states."""
    e, a = f.expected_orders(spark, d), f.actual_orders(spark, d)
    price: Callable[[DataFrame], DataFrame] = lambda x: x.select("o_custkey", F.col("price").cast("double").alias("price"))
    out = mergeable.distribution_drift(price(e), price(a), ["o_custkey"], mergeable.histogram("price", 0, 60_000, 8))
    rounded: Column = F.round("distance", 9)
    return out.withColumn("distance", rounded)

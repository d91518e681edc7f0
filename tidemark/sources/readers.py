"""Readers of source and target datasets. Decoding, splitting and push-down are Spark's; what is added are the guards."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.columns import declared, glob_regex
from tidemark.sources import strict_json

#: JDBC driver and catalog query of each database.
DIALECTS = {
    "sqlserver": ("com.microsoft.sqlserver.jdbc.SQLServerDriver", "SELECT table_schema, table_name, column_name, data_type, is_nullable, ordinal_position FROM information_schema.columns"),
    "postgresql": ("org.postgresql.Driver", "SELECT table_schema, table_name, column_name, data_type, is_nullable, ordinal_position FROM information_schema.columns"),
    "oracle": ("oracle.jdbc.OracleDriver", "SELECT owner AS table_schema, table_name, column_name, data_type, nullable AS is_nullable, column_id AS ordinal_position FROM all_tab_columns"),
    "db2": ("com.ibm.db2.jcc.DB2Driver", "SELECT tabschema AS table_schema, tabname AS table_name, colname AS column_name, typename AS data_type, nulls AS is_nullable, colno AS ordinal_position FROM syscat.columns"),
}

_KEYS = "SELECT k.table_schema, k.table_name, k.constraint_name, c.constraint_type AS kind, k.column_name, k.ordinal_position, u.table_schema AS to_schema, u.table_name AS to_table, u.column_name AS to_column FROM information_schema.key_column_usage k JOIN information_schema.table_constraints c ON c.constraint_schema = k.constraint_schema AND c.constraint_name = k.constraint_name LEFT JOIN information_schema.referential_constraints r ON r.constraint_schema = k.constraint_schema AND r.constraint_name = k.constraint_name LEFT JOIN information_schema.key_column_usage u ON u.constraint_schema = r.unique_constraint_schema AND u.constraint_name = r.unique_constraint_name AND u.ordinal_position = k.ordinal_position WHERE c.constraint_type IN ('PRIMARY KEY', 'FOREIGN KEY')"
#: Catalog query of each database for primary and foreign keys, a row a column.
KEYS = {
    "sqlserver": _KEYS,
    "postgresql": _KEYS,
    "oracle": "SELECT c.owner AS table_schema, c.table_name, c.constraint_name, CASE c.constraint_type WHEN 'P' THEN 'PRIMARY KEY' ELSE 'FOREIGN KEY' END AS kind, k.column_name, k.position AS ordinal_position, u.owner AS to_schema, u.table_name AS to_table, u.column_name AS to_column FROM all_constraints c JOIN all_cons_columns k ON k.owner = c.owner AND k.constraint_name = c.constraint_name LEFT JOIN all_cons_columns u ON u.owner = c.r_owner AND u.constraint_name = c.r_constraint_name AND u.position = k.position WHERE c.constraint_type IN ('P', 'R')",
    "db2": "SELECT c.tabschema AS table_schema, c.tabname AS table_name, c.constname AS constraint_name, CASE c.type WHEN 'P' THEN 'PRIMARY KEY' ELSE 'FOREIGN KEY' END AS kind, k.colname AS column_name, k.colseq AS ordinal_position, r.reftabschema AS to_schema, r.reftabname AS to_table, u.colname AS to_column FROM syscat.tabconst c JOIN syscat.keycoluse k ON k.tabschema = c.tabschema AND k.tabname = c.tabname AND k.constname = c.constname LEFT JOIN syscat.references r ON r.tabschema = c.tabschema AND r.tabname = c.tabname AND r.constname = c.constname LEFT JOIN syscat.keycoluse u ON u.tabschema = r.reftabschema AND u.tabname = r.reftabname AND u.constname = r.refkeyname AND u.colseq = k.colseq WHERE c.type IN ('P', 'F')",
}

#: Catalog query of each database for the rows that it takes a table to have.
ESTIMATES = {
    "sqlserver": "SELECT s.name AS table_schema, t.name AS table_name, SUM(p.row_count) AS n_rows FROM sys.tables t JOIN sys.schemas s ON s.schema_id = t.schema_id JOIN sys.dm_db_partition_stats p ON p.object_id = t.object_id WHERE p.index_id IN (0, 1) GROUP BY s.name, t.name",
    "postgresql": "SELECT n.nspname AS table_schema, c.relname AS table_name, CAST(c.reltuples AS BIGINT) AS n_rows FROM pg_class c JOIN pg_namespace n ON n.oid = c.relnamespace WHERE c.relkind IN ('r', 'p')",
    "oracle": "SELECT owner AS table_schema, table_name, num_rows AS n_rows FROM all_tables",
    "db2": "SELECT tabschema AS table_schema, tabname AS table_name, card AS n_rows FROM syscat.tables WHERE type = 'T'",
}

#: What a session says first, so that its reads repeat.
REPEATABLE = {
    "sqlserver": "SET TRANSACTION ISOLATION LEVEL REPEATABLE READ",
    "postgresql": "SET SESSION CHARACTERISTICS AS TRANSACTION ISOLATION LEVEL REPEATABLE READ",
    "oracle": "ALTER SESSION SET ISOLATION_LEVEL = SERIALIZABLE",
    "db2": "SET CURRENT ISOLATION = RS",
}


def jdbc_options(dialect: str, url: str, table: str, *, partition: tuple[str, object, object, int] | None = None, decimals: dict[str, str] | None = None, consistent: bool = False, fetch: int = 10_000, **properties: str) -> dict[str, str]:
    """Options of a table scan. partition: column, lower and upper bound, number; consistent: one statement of one session at a repeatable isolation level; several scans may still see several states."""
    if dialect not in DIALECTS:
        raise ValueError(f"no dialect {dialect!r}")
    out = {"url": url, "dbtable": table, "driver": DIALECTS[dialect][0], "fetchsize": str(fetch), **properties}
    if decimals:
        out["customSchema"] = ", ".join(f"{k} {v}" for k, v in decimals.items())
    if consistent:
        out |= {"numPartitions": "1", "sessionInitStatement": REPEATABLE[dialect]}
    elif partition:
        out |= dict(zip(("partitionColumn", "lowerBound", "upperBound", "numPartitions"), map(str, partition)))
    return out


@dataclass(frozen=True)
class Consistency:
    """How a read of several tables or partitions hangs together: what was asked for, what the scan does, and why it is less."""

    asked: str
    strategy: str
    reason: str = ""

    @property
    def downgraded(self) -> bool:
        return self.asked != self.strategy

    def said(self) -> str:
        """As it stands in a capture's manifest."""
        return f"{self.strategy} (asked for {self.asked}: {self.reason})" if self.downgraded else self.strategy


def consistency(dialect: str, asked: str = "snapshot", partitions: int = 1, tables: int = 1) -> Consistency:
    """The strategy of a scan by JDBC: repeatable (one session reads one table at the level of REPEATABLE) or none.

    A snapshot would need one transaction for all connections, which Spark's scans don't share; the
    downgrade is said, never silent.
    """
    if asked not in ("snapshot", "repeatable", "none"):
        raise ValueError(f"no strategy {asked!r}")
    if asked == "none":
        return Consistency(asked, "none")
    if partitions > 1:
        return Consistency(asked, "none", f"{partitions} connections read one table, each in a transaction of its own")
    if tables > 1:
        return Consistency(asked, "none", f"{tables} tables are read by connections of their own")
    return Consistency(asked, "repeatable", "" if asked == "repeatable" else f"{dialect} gives a scan one repeatable statement, no transaction over several")


def read_consistent(spark: SparkSession, dialect: str, url: str, table: str, columns: list[str] | None = None, asked: str = "snapshot", **options) -> tuple[DataFrame, Consistency]:
    """(the table, how it is read); the second goes into the manifest of a capture by said()."""
    partition = options.get("partition")
    how = consistency(dialect, asked, partition[3] if partition else 1)
    return read_table(spark, dialect, url, table, columns, consistent=how.strategy == "repeatable", **options), how


def read_table(spark: SparkSession, dialect: str, url: str, table: str, columns: list[str] | None = None, **options) -> DataFrame:
    df = spark.read.format("jdbc").options(**jdbc_options(dialect, url, table, **options)).load()
    return pick(df, columns) if columns else df


def read_catalog(spark: SparkSession, dialect: str, url: str, **properties: str) -> DataFrame:
    return spark.read.format("jdbc").options(url=url, query=DIALECTS[dialect][1], driver=DIALECTS[dialect][0], **properties).load()


def _asked(spark: SparkSession, dialect: str, url: str, query: str, properties: dict[str, str]) -> DataFrame:
    return spark.read.format("jdbc").options(url=url, query=query, driver=DIALECTS[dialect][0], **properties).load()


def keys_of(columns: DataFrame) -> DataFrame:
    """Key columns as a catalog lists them, a row a key: table_schema, table_name, constraint_name, kind (primary, foreign), columns, to_schema, to_table, to_columns (in the key's order)."""
    lower = columns.withColumnsRenamed({c: c.lower() for c in columns.columns})
    parts = F.array_sort(F.collect_list(F.struct(F.col("ordinal_position").cast("int").alias("no"), "column_name", "to_column")))
    grouped = lower.groupBy("table_schema", "table_name", "constraint_name", "kind", "to_schema", "to_table").agg(parts.alias("p"))
    return grouped.select("table_schema", "table_name", "constraint_name", F.when(F.col("kind") == "PRIMARY KEY", "primary").otherwise("foreign").alias("kind"), F.col("p.column_name").alias("columns"), "to_schema", "to_table", F.array_compact("p.to_column").alias("to_columns"))


def read_keys(spark: SparkSession, dialect: str, url: str, **properties: str) -> DataFrame:
    """Primary and foreign keys of all tables, as keys_of gives them."""
    return keys_of(_asked(spark, dialect, url, KEYS[dialect], properties))


def read_estimates(spark: SparkSession, dialect: str, url: str, **properties: str) -> DataFrame:
    """table_schema, table_name and n_rows as the database estimates them; null where it doesn't."""
    found = _asked(spark, dialect, url, ESTIMATES[dialect], properties)
    named = found.withColumnsRenamed({c: c.lower() for c in found.columns})
    return named.select("table_schema", "table_name", F.when(F.col("n_rows") >= 0, F.col("n_rows").cast("long")).alias("n_rows"))


def pick(df: DataFrame, columns: list[str], keys: list[str] = ()) -> DataFrame:
    """The named columns and the keys; Catalyst prunes the scan. An unknown one is an error."""
    wanted = list(dict.fromkeys([*keys, *columns]))
    if lost := [c for c in wanted if c not in df.columns]:
        raise ValueError(f"no such column: {', '.join(lost)}")
    return df.select(*wanted)


def read_csv(spark: SparkSession, path: str, sep: str = ",", multiline: bool = False) -> DataFrame:
    """Every field as text. The header must be there, without blanks or repeats; a row of another width is an error when read."""
    first = spark.read.csv(path, header=False, sep=sep, inferSchema=False).limit(1).collect()
    names = list(first[0]) if first else []
    if not names or any(n is None or not n.strip() for n in names) or len(set(names)) < len(names):
        raise ValueError(f"{path}: the header is missing, or has blank or repeated names")
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return spark.read.csv(path, header=True, sep=sep, schema=schema, enforceSchema=False, mode="FAILFAST", encoding="UTF-8", multiLine=multiline)


def read_json(spark: SparkSession, path: str, schema: str | None = None, lines: bool = False, rejects: bool = False) -> DataFrame:
    """A JSON array a file, or with lines one object a line. rejects: bad rows come back in _corrupt_record instead of failing.

    With a schema the reading is strict (see strict_json): a repeated property, a value of another type and a number that
    loses digits are bad rows, and its types are exact ones. Without one Spark infers it, and the last of repeated properties wins.
    """
    if schema is None:
        return spark.read.option("multiLine", not lines).option("mode", "PERMISSIVE" if rejects else "FAILFAST").json(path)
    return strict_json.typed_records(spark, path, T.StructType.fromDDL(schema), lines, rejects)


def read_xml(spark: SparkSession, path: str, row_tag: str, schema: str | T.StructType | None = None) -> DataFrame:
    reader = spark.read.option("rowTag", row_tag).option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).xml(path)


@dataclass(frozen=True)
class Field:
    """A declared field of a text file: kind and options as columns.declared takes them; start counts from 1."""

    name: str
    kind: str = "string"
    start: int = 0
    length: int = 0
    path: str = ""
    options: tuple[tuple[str, object], ...] = ()


def text_lines(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """value: the lines of text files in an encoding. Only the CSV source decodes others than UTF-8; it passes over empty lines."""
    if encoding.upper() in ("UTF-8", "UTF8"):
        return spark.read.text(path)
    # one column: a separator that no text has, and nothing that quotes or escapes
    return spark.read.csv(path, schema="value string", sep="\u0001", quote="", escape="\u0002", encoding=encoding, lineSep="\n", mode="FAILFAST", maxCharsPerColumn=-1)


def read_fixed_width(spark: SparkSession, path: str, fields: list[Field], width: int, encoding: str = "UTF-8") -> tuple[DataFrame, DataFrame]:
    """(rows, rejects): rejects are lines of another width (in characters), and lines with a field that does not parse."""
    taken: set[int] = set()
    for f in fields:
        span = set(range(f.start, f.start + f.length))
        if f.start < 1 or f.start + f.length - 1 > width or taken & span:
            raise ValueError(f"{f.name}: overlaps another field or leaves the line")
        taken |= span
    lines = text_lines(spark, path, encoding)
    raw = lambda f: F.substring("value", f.start, f.length)
    parsed = lines.select("value", *[declared(raw(f), f.kind, **dict(f.options)).alias(f.name) for f in fields])
    lost = F.lit(False)
    for f in fields:
        null_text = dict(f.options).get("null_text")
        empty = (F.trim(raw(f)) == "") | (F.trim(raw(f)) == F.lit(null_text) if null_text is not None else F.lit(False))
        lost = lost | (F.col(f.name).isNull() & ~empty)
    bad = (F.length("value") != width) | lost
    return parsed.where(~bad).drop("value"), parsed.where(bad).select("value")


def extract(df: DataFrame, fields: list[Field]) -> DataFrame:
    """Declared fields of nested rows by dotted path."""
    return df.select(*[declared(F.col(f.path or f.name).cast("string"), f.kind, **dict(f.options)).alias(f.name) for f in fields])


#: Types that a reconciled Parquet file may have.
FLAT = (T.StringType, T.LongType, T.IntegerType, T.ShortType, T.ByteType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BinaryType, T.DecimalType)


def guard_flat(schema: T.StructType, precision: int = 28, doubles: bool = False) -> None:
    """Only exact, flat types: nested columns, floats (unless allowed) and wide decimals are errors before any row is read."""
    for f in schema.fields:
        ok = isinstance(f.dataType, FLAT) or doubles and isinstance(f.dataType, (T.FloatType, T.DoubleType))
        if not ok or isinstance(f.dataType, T.DecimalType) and f.dataType.precision > precision:
            raise TypeError(f"{f.name}: {f.dataType.simpleString()} is not an exact flat type")


#: Stores whose files a task's Python can open by ranges.
RANGED = ("file", "hdfs", "s3", "s3a", "gs", "abfss")


def parquet_footers(spark: SparkSession, path: str, files_a_task: int = 256) -> DataFrame:
    """A row a column and file, from the files' footers alone: file, column, physical, logical, repetition.

    Files are listed by Spark and their footers read in tasks, by ranges; of the data nothing is read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path").where(~F.col("path").rlike(r"/[_.][^/]*$"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs
        import pyarrow.parquet as pq

        for batch in batches:
            for file in batch.column("path").to_pylist():
                uri = re.sub("^s3a:", "s3:", file)
                store, at = pyarrow.fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", uri))
                with store.open_input_file(at) as f:
                    columns = pq.ParquetFile(f).schema
                seen = [columns.column(i) for i in range(len(columns.names))]
                rows = {
                    "file": [file] * len(seen), "column": [c.path for c in seen], "physical": [c.physical_type for c in seen], "logical": [str(c.logical_type) for c in seen],
                    "repetition": ["repeated" if c.max_repetition_level else "nested" if "." in c.path else "optional" if c.max_definition_level else "required" for c in seen],
                }
                yield pa.RecordBatch.from_pydict(rows)

    n = files.count() // files_a_task + 1
    return files.repartition(n).mapInArrow(read, "file string, column string, physical string, logical string, repetition string")


def guard_footers(spark: SparkSession, path: str) -> None:
    """INT96 columns, times of day and nanoseconds in any of the files are errors before any row is read.

    In a store that only Spark opens, the files' schemas as Spark sees them decide; there an INT96 column that
    Spark itself wrote can't be told from a timestamp.
    """
    scheme = path.partition("://")[0] if "://" in path else "file"
    if scheme in RANGED:
        bad = F.when(F.col("physical") == "INT96", "INT96").when(F.lower("logical").startswith("time("), "time of day").when(F.lower("logical").contains("nanoseconds"), "nanoseconds")
        found = parquet_footers(spark, path).withColumn("why", bad).where("why IS NOT NULL").orderBy("file", "column").first()
        if found:
            raise TypeError(f"{found['file']}: {found['column']}: {found['why']} is not an exact type")
        return
    was = spark.conf.get("spark.sql.parquet.int96AsTimestamp")
    try:
        spark.conf.set("spark.sql.parquet.int96AsTimestamp", "false")
        _ = spark.read.option("mergeSchema", True).parquet(path).schema
    finally:
        spark.conf.set("spark.sql.parquet.int96AsTimestamp", was)


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None, doubles: bool = False) -> DataFrame:
    """Parquet files of exact, flat types; the footers of all files are looked at first."""
    guard_footers(spark, path)
    df = spark.read.parquet(path)
    df = pick(df, columns) if columns else df
    guard_flat(df.schema, doubles=doubles)
    return df


def read_files(spark: SparkSession, root: str, pattern: str = "**") -> DataFrame:
    """Payload files (any Hadoop file system): path, relative_path, length, modified, sha256, content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    relative = F.regexp_replace("path", r"^.*?\Q" + root.split("://")[-1].strip("/") + r"\E/+", "")
    return files.select("path", relative.alias("relative_path"), "length", F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"), "content").where(F.col("relative_path").rlike(glob_regex(pattern)))


def listing(spark: SparkSession, root: str) -> DataFrame:
    """Path, length and time of each file; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select("path", "length", F.col("modificationTime").alias("modified"))


def changed_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """Files that came, went or changed between two listings."""
    b, a = before.select("path", F.struct("length", "modified").alias("b")), after.select("path", F.struct("length", "modified").alias("a"))
    return b.join(a, "path", "full_outer").where(~F.col("b").eqNullSafe(F.col("a")))


def bad_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Identities that are null in part or repeated: keys, n, code (null, repeated)."""
    null = " OR ".join(f"`{k}` IS NULL" for k in keys)
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(f"n > 1 OR {null}")
    return counted.withColumn("code", F.when(F.expr(null), "null").otherwise("repeated"))


def normalised(df: DataFrame) -> DataFrame:
    """df in the library's value types: integers as long, decimals as they are, floating-point values as text (they have no exact form), times of files in UTC."""
    cast = {"tinyint": "long", "smallint": "long", "int": "long", "float": "string", "double": "string"}
    return df.select(*[F.col(f"`{f.name}`").cast(cast[f.dataType.simpleString()]).alias(f.name) if f.dataType.simpleString() in cast else F.col(f"`{f.name}`") for f in df.schema.fields])

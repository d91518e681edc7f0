"""JSON read without loss: repeated properties, inexact numbers and values of another kind are rejects, not surprises.

Every record is parsed as a VARIANT, which refuses a property that occurs twice
at any depth and keeps numbers of up to 38 digits as decimals. A declared value
is held against the kind that the record gives it. A number that a VARIANT can
only hold as a double (with an exponent, or of more digits) is a reject. All of
it stays in the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.columns import declared

#: Most digits of an exact number.
DIGITS = 38
# Fixed value: the kind of a number that is not kept digit by digit.
INEXACT = "DOUBLE"


@dataclass(frozen=True)
class Property:
    """A declared property: a dotted path (the name, if empty) and a kind: string, integer, decimal, boolean, date, timestamp, object, collection.

    scale: digits after the point of a decimal; options: what columns.declared takes.
    """

    name: str
    kind: str = "string"
    path: str = ""
    scale: int = 18
    options: tuple[tuple[str, object], ...] = field(default=())

    @property
    def at(self) -> list[str]:
        steps = (self.path or self.name).split(".")
        if any(not s or "[" in s or "`" in s or "'" in s for s in steps):
            raise ValueError(f"{self.name}: a path is names with dots between them")
        return steps


def exact_number(c: Column, scale: int) -> Column:
    """The text of a plain number as decimal(38, scale), null unless every digit survives."""
    shape = r"^-?(\d+)(?:\.(\d+))?$"
    needed = F.length(F.rtrim(F.regexp_extract(c, shape, 2), F.lit("0")))
    return F.when(c.rlike(shape) & (needed <= scale), c.try_cast(f"decimal({DIGITS},{scale})"))


def _value(p: Property, kind: Column, found: Column) -> Column:
    """The declared value of a VARIANT, null where that has another kind or isn't exact."""
    text = F.try_variant_get(found, "$", "string")
    is_text = kind == "STRING"
    from_text = F.when(is_text, declared(text, p.kind, **({"scale": p.scale} if p.kind == "decimal" else {}), trim=False, **dict(p.options))) if p.kind not in ("object", "collection") else None
    if p.kind == "integer":
        return F.coalesce(from_text, F.when(kind == "BIGINT", text.try_cast("long")))
    if p.kind == "decimal":
        return F.coalesce(from_text, F.when(kind.rlike("^(BIGINT|DECIMAL)"), exact_number(text, p.scale)))
    if p.kind == "boolean":
        return F.coalesce(from_text, F.when(kind == "BOOLEAN", text == "true"))
    if p.kind in ("object", "collection"):
        return F.when(kind.startswith("OBJECT<" if p.kind == "object" else "ARRAY<") & ~kind.contains(INEXACT), F.to_json(found))
    return from_text


def _once(df: DataFrame) -> DataFrame:
    """df, whose columns are worked out once a row. Otherwise a filter on what is made of them works them out again wherever it names them, and a text is parsed hundreds of times."""
    return df.select(F.inline_outer(F.array(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))


def _parsed(df: DataFrame, record: str, keep: list[str]) -> DataFrame:
    """keep, _record, _variant, and _broken: why a text is no VARIANT."""
    parsed = _once(df.select(*keep, F.col(record).alias("_record"), F.try_parse_json(record).alias("_variant")))
    return parsed.withColumn("_broken", F.when(F.col("_variant").isNull(), F.when(F.get_json_object("_record", "$").isNull(), "syntax").otherwise("repeated")))


def judged(parsed: DataFrame, properties: list[Property], keep: list[str] = ()) -> DataFrame:
    """keep, _record, the properties, and _code and _lost: what is wrong with a record, and the properties whose values are. parsed: as _parsed gives it."""
    at = lambda p: F.try_variant_get("_variant", "$" + "".join(f"['{s}']" for s in p.at), "variant")
    found = _once(parsed.select("*", *[at(p).alias(f"_found{i}") for i, p in enumerate(properties)]))
    found = _once(found.select("*", *[F.schema_of_variant(f"_found{i}").alias(f"_kind{i}") for i in range(len(properties))]))
    read = _once(found.select("*", *[_value(p, F.col(f"_kind{i}"), F.col(f"_found{i}")).alias(f"_value{i}") for i, p in enumerate(properties)]))

    def gone(i: int, p: Property) -> Column:
        kind = F.col(f"_kind{i}")
        said_null = (kind == "STRING") if "null_text" in dict(p.options) else F.lit(False)
        return kind.isNotNull() & (kind != "VOID") & F.col(f"_value{i}").isNull() & ~said_null

    lost = F.array_compact(F.array(*[F.when(gone(i, p), F.lit(p.name)) for i, p in enumerate(properties)]))
    code = F.coalesce("_broken", F.when(~F.schema_of_variant("_variant").startswith("OBJECT<"), "not_an_object").when(F.size(lost) > 0, "kind"))
    return read.select(*keep, "_record", *[F.col(f"_value{i}").alias(p.name) for i, p in enumerate(properties)], code.alias("_code"), lost.alias("_lost"))


def parse_records(df: DataFrame, record: str, properties: list[Property], keep: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(rows: keep and the properties; rejects: keep, code and property), from a column of JSON texts.

    Codes: syntax, not_an_object, repeated (a property, at any depth), and kind (a value of another kind, or
    a number whose digits don't all fit). A null or missing property is null. Values are not in the rejects.
    """
    return _split(judged(_parsed(df, record, keep), properties, keep), properties, keep)


def _split(both: DataFrame, properties: list[Property], keep: list[str]) -> tuple[DataFrame, DataFrame]:
    rows = both.where("_code IS NULL").select(*keep, *[F.col(f"`{p.name}`") for p in properties])
    rejects = both.where("_code IS NOT NULL").select(*keep, F.col("_code").alias("code"), F.explode_outer(F.when(F.col("_code") == "kind", F.col("_lost"))).alias("property"))
    return rows, rejects


def _whole(parsed: DataFrame, keep: list[str]) -> tuple[DataFrame, DataFrame]:
    """With no properties declared: rows have the record as a VARIANT; an inexact number anywhere in it is a reject."""
    shape = F.schema_of_variant("_variant")
    code = F.coalesce("_broken", F.when(~shape.startswith("OBJECT<"), "not_an_object").when(shape.contains(INEXACT), "kind"))
    both = parsed.withColumn("code", code)
    return both.where("code IS NULL").select(*keep, F.col("_variant").alias("record")), both.where("code IS NOT NULL").select(*keep, "code", F.lit(None).cast("string").alias("property"))


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """file, block and place (which give a line's number) and record, a row a line; files are split over tasks."""
    lines = spark.read.text(path).withColumn("place", F.monotonically_increasing_id())
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "place", F.col("value").alias("record"))


def with_line_numbers(found: DataFrame, lines: DataFrame) -> DataFrame:
    """found (with file, block, place) with the number of its line in the file: lines are counted by block, and places in a block are consecutive."""
    blocks = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("_n"), F.min("place").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = blocks.select("file", "block", (before - F.col("_first") + 1).alias("_start"))
    rest = [c for c in found.columns if c not in ("file", "block", "place")]
    return found.join(starts, ["file", "block"]).select("file", (F.col("place") + F.col("_start")).alias("line"), *rest)


def read_ndjson(spark: SparkSession, path: str, properties: list[Property] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects with file and line) of files with one object a line. An empty line is a reject. With no properties, rows hold each record as a VARIANT."""
    lines = lines_of(spark, path)
    where = ["file", "block", "place"]
    parsed = _parsed(lines, "record", where)
    rows, rejects = _split(judged(parsed, properties, where), properties, where) if properties else _whole(parsed, where)
    return rows.drop(*where), with_line_numbers(rejects, lines)


def array_items(texts: DataFrame, text: str, keep: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(keep, position and the items, parsed; keep and code of the texts that are no array)."""
    parsed = _parsed(texts, text, keep)
    is_array = F.coalesce(F.schema_of_variant("_variant").startswith("ARRAY<"), F.lit(False))
    items = parsed.where(is_array).lateralJoin(texts.sparkSession.tvf.variant_explode(F.col("_variant").outer())).select(*keep, F.col("pos").alias("position"), F.to_json("value").alias("_record"), F.col("value").alias("_variant"), F.lit(None).cast("string").alias("_broken"))
    return items, parsed.where(~is_array).select(*keep, "_record", F.coalesce("_broken", F.lit("not_an_array")).alias("code"))


def read_array(spark: SparkSession, path: str, properties: list[Property] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects with file and position) of files that hold one array of objects each.

    A file is one VARIANT, whose size Spark bounds (128 MB); a larger one is a reject as a whole: write it as NDJSON.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    items, broken = array_items(files, "value", ["file"])
    where = ["file", "position"]
    rows, rejects = _split(judged(items, properties, where), properties, where) if properties else _whole(items, where)
    none = lambda kind: F.lit(None).cast(kind)
    return rows.drop(*where), rejects.unionByName(broken.select("file", none("int").alias("position"), "code", none("string").alias("property")))


#: Kinds of the types of a schema; narrower integers are held against their range.
KINDS = {"string": "string", "tinyint": "integer", "smallint": "integer", "int": "integer", "bigint": "integer", "boolean": "boolean", "date": "date", "timestamp": "timestamp", "timestamp_ntz": "timestamp"}


def _leaves(kind: T.StructType, path: tuple[str, ...] = ()) -> list[tuple[tuple[str, ...], T.DataType]]:
    return [x for f in kind.fields for x in (_leaves(f.dataType, (*path, f.name)) if isinstance(f.dataType, T.StructType) else [((*path, f.name), f.dataType)])]


def _property(path: tuple[str, ...], kind: T.DataType) -> Property:
    name = ".".join(path)
    if isinstance(kind, T.DecimalType):
        return Property(name, "decimal", name, kind.scale)
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return Property(name, "collection" if isinstance(kind, T.ArrayType) else "object", name)
    if kind.simpleString() not in KINDS:
        raise TypeError(f"{name}: {kind.simpleString()} is not an exact type")
    return Property(name, KINDS[kind.simpleString()], name)


def typed_records(spark: SparkSession, path: str, schema: T.StructType, lines: bool, rejects: bool = False) -> DataFrame:
    """Records in the types of a schema. A bad one is an error that names its fault, or with rejects a row of nulls with the text in _corrupt_record."""
    if lines:
        parsed = _parsed(spark.read.text(path), "value", [])
    else:
        items, broken = array_items(spark.read.text(path, wholetext=True), "value")
        parsed = items.drop("position").unionByName(broken.select("_record", F.lit(None).cast("variant").alias("_variant"), F.col("code").alias("_broken")))
    leaves = _leaves(schema)
    both = judged(parsed, [_property(p, t) for p, t in leaves])
    name = lambda p: F.col(f"`{'.'.join(p)}`")
    typed = {p: F.from_json(name(p), t.simpleString()) if isinstance(t, (T.ArrayType, T.MapType)) else name(p).try_cast(t) for p, t in leaves}
    narrow = F.array_compact(F.array(*[F.when(name(p).isNotNull() & c.isNull(), F.lit(".".join(p))) for p, c in typed.items()]))
    code = F.coalesce("_code", F.when(F.size(narrow) > 0, "kind"))
    built = lambda kind, path: [(F.struct(*built(f.dataType, (*path, f.name))) if isinstance(f.dataType, T.StructType) else typed[(*path, f.name)]).alias(f.name) for f in kind.fields]
    if rejects:
        return both.select(*[F.when(code.isNull(), c).alias(f.name) for c, f in zip(built(schema, ()), schema.fields)], F.when(code.isNotNull(), F.col("_record")).alias("_corrupt_record"))
    said = F.concat(F.lit("JSON record refused: "), code, F.lit(" "), F.array_join(F.concat("_lost", narrow), ", "))
    # a filter, so that no projection or count passes by it
    return both.where(F.when(code.isNull(), True).otherwise(F.raise_error(said).cast("boolean"))).select(*built(schema, ()))

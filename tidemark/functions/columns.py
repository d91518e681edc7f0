"""Column builders for values: cleaning, parsing, comparing. All but normalize_upper stay inside the JVM."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends; null stays null."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


@F.pandas_udf(T.StringType())
def normalize_upper(s: pd.Series) -> pd.Series:
    """NFKC, then upper case character by character (a character whose upper case is longer stays). Spark has no function for either."""
    one = lambda ch: u if len(u := ch.upper()) == 1 else ch
    return s.map(lambda x: None if x is None else x.upper() if x.isascii() else "".join(map(one, unicodedata.normalize("NFKC", x))))


def parse_date(c: Column, pattern: str = "yyyy-MM-dd") -> Column:
    """A date, or null where the text does not follow the pattern."""
    return F.try_to_timestamp(c, F.lit(pattern)).cast("date")


def as_date(c: Column) -> Column:
    """A date from ISO or compact text, else null."""
    return F.coalesce(parse_date(F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), c)), parse_date(F.when(c.rlike(r"^\d{8}$"), c), "yyyyMMdd"))


def as_decimal(c: Column, scale: int = 6) -> Column:
    """decimal(38, scale), or null where the value is no number that fits."""
    return c.try_cast(f"decimal(38,{scale})")


def exact_decimal(c: Column, scale: int) -> Column:
    """The text as a decimal only if all its digits survive, else null."""
    plain = c.rlike(rf"^[+-]?\d+(\.\d{{1,{scale}}}0*)?$") if scale else c.rlike(r"^[+-]?\d+(\.0*)?$")
    return F.when(plain, c.try_cast(f"decimal(38,{scale})"))


def as_text(c: Column, kind: str = "string") -> Column:
    """Text of a value; null becomes empty, decimals lose trailing zeros, dates are ISO."""
    if kind.startswith("decimal"):
        text = F.regexp_replace(F.regexp_replace(c.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    elif kind == "timestamp":
        text = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    else:
        text = c.cast("string")
    return F.coalesce(text, F.lit(""))


def code_map(c: Column, codes: dict[str, str], unknown: str = "null", default: str | None = None) -> Column:
    """Exact look-up. unknown: "null" leaves a code that is not there null (for the rejects), "keep" keeps it, "default" takes default."""
    if unknown not in ("null", "keep", "default"):
        raise ValueError(f"unknown must be null, keep or default, not {unknown!r}")
    found = F.element_at(F.create_map(*[F.lit(x) for kv in codes.items() for x in kv]), c) if codes else F.lit(None).cast("string")
    return {"null": found, "keep": F.coalesce(found, c), "default": F.when(c.isNotNull(), F.coalesce(found, F.lit(default)))}[unknown]


def join_strict(separator: str, *parts: Column) -> Column:
    """Parts with a separator; null if any part is."""
    between = [x for p in parts for x in (F.lit(separator), p)][1:]
    return F.concat(*between)


def split_literal(c: Column, separator: str) -> Column:
    return F.split(c, r"\Q" + separator.replace(r"\E", r"\E\\E\Q") + r"\E")


def has_offset(c: Column) -> Column:
    """Whether a text is a timestamp with an explicit offset."""
    return F.coalesce(c.rlike(r"T.*(Z|[+-]\d{2}:\d{2})$") & F.try_to_timestamp(c).isNotNull(), F.lit(False))


def timestamp_kind(c: Column) -> Column:
    """(has_offset, micros): zoned and local timestamps stay apart; micros is null where the text is no timestamp."""
    zoned = has_offset(c)
    # a local time counts as UTC, so that only the flag keeps it from a zoned one
    return F.struct(zoned.alias("has_offset"), F.unix_micros(F.try_to_timestamp(F.when(zoned, c).otherwise(F.concat(c, F.lit("Z"))))).alias("micros"))


def reference_key(c: Column, kind: str) -> Column:
    """The id in a reference `kind/id` of exactly one slash, else null."""
    return F.nullif(F.regexp_extract(c, rf"^\Q{kind}\E/([^/]+)$", 1), F.lit(""))


def beyond(expected: Column, actual: Column, tolerance) -> Column:
    """Whether two numbers differ by more than a tolerance; a null on either side differs."""
    return F.coalesce(F.abs(expected - actual) > F.lit(tolerance), F.lit(True))


def same_texts(pairs: list[tuple[Column, Column]]) -> Column:
    """Whether all pairs are equal as text."""
    out = F.lit(True)
    for e, a in pairs:
        out = out & (as_text(e) == as_text(a))
    return out


def same_digest(expected: Column, actual: Column) -> Column:
    """Whether two hex digests are equal in either case; an empty or null expected one never is."""
    return F.coalesce((F.lower(expected) == F.lower(actual)) & (expected != ""), F.lit(False))


def net_holds(gross: Column, deductions: Column, net: Column) -> Column:
    return F.coalesce(net == gross - deductions, F.lit(False))


def redacted(c: Column, allowed: tuple[str, ...] = ()) -> Column:
    """A digest in place of a text, unless it is an allowed one."""
    hashed = F.concat(F.lit("sha256:"), F.sha2(c.cast("binary"), 256))
    return F.when(c.isin(*allowed), c).otherwise(hashed) if allowed else hashed


def percentage(part: Column, whole: Column) -> Column:
    """100 * part / whole to four decimals; null where whole is 0."""
    return F.round(F.lit(100).cast("decimal(20,0)") * part / F.nullif(whole, F.lit(0)), 4)


def declared(c: Column, kind: str, *, trim: bool = True, null_text: str | None = None, true: tuple[str, ...] = ("true",), false: tuple[str, ...] = ("false",), scale: int = 0, implied: bool = False, pattern: str | None = None) -> Column:
    """Text of a file read as a declared kind: string, integer, decimal (implied: the last scale digits are decimals), boolean, date, timestamp. What does not parse is null."""
    x = strip(c) if trim else c
    x = F.nullif(x, F.lit(null_text)) if null_text is not None else x
    if kind == "string":
        return x
    if kind == "integer":
        return x.try_cast("long")
    if kind == "decimal":
        return (F.when(x.rlike(r"^[+-]?\d+$"), x).try_cast("decimal(28,0)") / F.lit(10**scale)).cast(f"decimal(38,{scale})") if implied else exact_decimal(x, scale)
    if kind == "boolean":
        return F.when(x.isin(*true), True).when(x.isin(*false), False)
    if kind == "date":
        return parse_date(x, pattern or "yyyy-MM-dd")
    if kind == "timestamp":
        return F.try_to_timestamp(x, F.lit(pattern)) if pattern else F.try_to_timestamp(x)
    raise ValueError(f"no such kind: {kind!r}")


def glob_regex(pattern: str) -> str:
    """An anchored regular expression for a relative path: `**/` any folders, `**` anything, `*` and `?` within a name."""
    known = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    return "^" + "".join(known.get(x) or re.escape(x) for x in re.findall(r"\*\*/|\*\*|\*|\?|[^*?]+", pattern)) + "$"


def prefixed(*parts: Column) -> Column:
    """Parts as one text that no other parts give: each with its length in bytes before it. Null if any part is."""
    return F.concat(*[x for p in parts for x in (F.octet_length(p.cast("string")).cast("string"), F.lit(":"), p.cast("string"))])


def digest(*parts: Column) -> Column:
    return F.sha2(prefixed(*parts).cast("binary"), 256)


def evidence_id(run_id: Column, check_id: Column, key: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", run_id, check_id, key).cast("binary"), 256)


def typed_order(c: Column) -> Column:
    """A sort key for text of mixed kinds: numbers by value, then dates, then text by its bytes; null first."""
    number, day = as_decimal(c), as_date(c)
    kind = F.when(c.isNull(), 0).when(number.isNotNull(), 1).when(day.isNotNull(), 2).otherwise(3)
    return F.struct(kind.alias("kind"), number.alias("number"), day.alias("day"), c.alias("text"))

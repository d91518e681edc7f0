"""Secret scans with corpus-wide ownership frequency (DataFrame operations only).

Candidates are found with regular expressions and carry their spans in code
points. Each candidate's hash is counted over the whole corpus by distinct
repositories and owners. One that many owners or many repositories share is a
copied example; one that belongs to one owner and few repositories and looks
random is held to be live. Exact copies of a text within an owner count as one
repository.

Spans of the base kinds (assign, access, hex) always stay; the method adds
those of further kinds unless the corpus shows them to be shared examples.

Defined results: a null text counts as empty; a text without candidates gives
counts of 0, the digest of the empty string and no spans; null owners and
repositories count as one value each; null and repeated document ids are
ordinary rows; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import cut

# Kinds in the order that ties are listed in, with pattern, group of the credential,
# least length of that group (whole match: group 0), and whether letters match in either case.
BASE = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]{32,}", 0, 32),
}
EXTRA = {
    "bearer": (r"(?i)bearer\x20+([A-Za-z0-9._~+/=-]{20,})", 1, 20),
    "jwt": (r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 28),
    "forge": (r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    "login": (r"[a-z][a-z0-9+.-]{1,20}://[^\s:/@]{1,64}:([^\s/@]{6,128})@", 1, 6),
    "pem": (r"-----BEGIN\x20[A-Z\x20]{0,40}PRIVATE\x20KEY-----", 0, 1),
}
#: Spans are kept apart by this type.
SPAN = "array<struct<start:long,end:long,kind_no:int,kind:string,value:string>>"
#: A credential of so many owners or more is a shared example.
SHARED_OWNERS = 3
#: So is one of so many repositories or more, even of one owner.
SHARED_REPOSITORIES = 10
#: Credentials of this share of all places or more are joined by broadcast (100,000 hashes at most).
COMMON_SHARE = 1e-5


def matches(text: Column, kind: str, no: int, pattern: str, group: int, least: int) -> Column:
    """Spans of a pattern's leftmost non-overlapping matches whose credential is long enough.

    Spark has no function for match positions: what lies between the matches (split) and the
    matches themselves are measured in turn. Texts without a match pay for one search only.
    """
    gaps, found, value = F.split(text, pattern), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    parts = F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), found.alias("found"), value.alias("value"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["found"])
        span = F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"), F.lit(no).alias("kind_no"), F.lit(kind).alias("kind"), x["value"].alias("value"))
        return F.struct(end.cast("long").alias("at"), F.when(F.length(x["value"]) >= least, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(SPAN).alias("spans"))
    return F.when(text.rlike(pattern), F.aggregate(parts, start, step, lambda acc: acc["spans"])).otherwise(F.array().cast(SPAN))


def scan(docs: DataFrame, repository: str = "doc_id", owner: str = "source") -> DataFrame:
    """A row a document: row_no, doc_id, repository, owner, text_hash, base and extra spans by start; written once, as the corpus counts need it again."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = F.array_sort(F.concat(*[matches(text, k, i, *v) for i, (k, v) in enumerate(BASE.items())]))
    more = F.array_sort(F.concat(*[matches(text, k, i + len(BASE), *v) for i, (k, v) in enumerate(EXTRA.items())]))
    hint = text.rlike(r"(?i)eyJ|bearer\x20|gh[pousr]_|://|PRIVATE\x20KEY")
    return cut(docs.select(F.monotonically_increasing_id().alias("row_no"), "doc_id", F.col(repository).cast("string").alias("repository"), F.col(owner).cast("string").alias("owner"), F.xxhash64(text).alias("text_hash"), base.alias("base"), F.when(hint, more).otherwise(F.array().cast(SPAN)).alias("extra")))


def ownership(found: DataFrame) -> DataFrame:
    """A row a credential hash: n_repositories, n_owners, n_places, over the whole corpus. Counts are taken level by level, so a widely copied credential is spread over its repositories first."""
    texts = found.groupBy("hash", F.coalesce("owner", F.lit("")).alias("owner"), "text_hash").agg(F.min(F.coalesce("repository", F.lit(""))).alias("repository"), F.count(F.lit(1)).alias("n"))
    once = texts.groupBy("hash", "owner", "repository").agg(F.sum("n").alias("n"))
    return once.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("n_repositories"), F.sum("n").alias("n")).groupBy("hash").agg(F.sum("n_repositories").alias("n_repositories"), F.count(F.lit(1)).alias("n_owners"), F.sum("n").alias("n_places"))


def with_ownership(found: DataFrame, common: float = COMMON_SHARE) -> DataFrame:
    """found with n_repositories and n_owners of each place's hash.

    Hashes of a share of all places are broadcast, which are 1 / common at most whatever the corpus's
    size; the others are joined by hash, where none has more rows than that share.
    """
    counts = cut(ownership(found))
    bar = common * (counts.agg(F.sum("n_places")).first()[0] or 0)
    many, few = counts.where(F.col("n_places") >= bar).drop("n_places"), counts.where(F.col("n_places") < bar).drop("n_places")
    rest = found.join(F.broadcast(many.select("hash")), "hash", "left_anti").join(few, "hash")
    return found.join(F.broadcast(many), "hash").unionByName(rest)


def verdict(value: Column, n_owners: Column, n_repositories: Column, shared: int = SHARED_OWNERS, copied: int = SHARED_REPOSITORIES) -> Column:
    """example: many owners or repositories have it; live: one owner, and of many different characters; unsure: the rest."""
    varied = F.size(F.array_distinct(F.split(value, ""))) >= 8
    return F.when((n_owners >= shared) | (n_repositories >= copied), "example").when((n_owners == 1) & varied, "live").otherwise("unsure")


def secrets(docs: DataFrame, repository: str = "doc_id", owner: str = "source") -> DataFrame:
    """A row a document: doc_id, base spans, all spans (with verdicts), n_live, n_example."""
    scanned = scan(docs, repository, owner)
    found = scanned.select("row_no", "repository", "owner", "text_hash", F.explode(F.concat("base", "extra")).alias("span")).withColumn("hash", F.sha2(F.col("span.value").cast("binary"), 256))
    judged = with_ownership(found).select("row_no", F.struct("span.start", "span.end", "span.kind_no", "span.kind", verdict(F.col("span.value"), F.col("n_owners"), F.col("n_repositories")).alias("verdict"), "hash", "n_owners", "n_repositories").alias("span"))
    by_row = judged.groupBy("row_no").agg(F.array_sort(F.collect_list("span")).alias("all"))
    none = by_row.schema["all"].dataType
    return scanned.join(by_row, "row_no", "left").select(
        "doc_id", "base",
        F.coalesce(F.filter("all", lambda x: (x["kind_no"] < len(BASE)) | (x["verdict"] != "example")), F.array().cast(none)).alias("spans"),
        F.coalesce(F.size(F.filter("all", lambda x: x["verdict"] == "live")), F.lit(0)).alias("n_live"),
        F.coalesce(F.size(F.filter("all", lambda x: x["verdict"] == "example")), F.lit(0)).alias("n_example"),
    )


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: the digest of the scan of all documents; an owner is a source, a repository a document."""
    out = secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", *map(count, BASE), F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), "n_live", "n_example")



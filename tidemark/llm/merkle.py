"""Merkle manifest of a dataset, with a proof for every row (DataFrame operations only).

Every row is a leaf. Leaves of a group (a language) are numbered in order; at
each level the first node of a run computes the indices of its siblings, an
equijoin fetches them, and it emits the run's parent, until one node a group is
left. The groups' roots are the leaves of a last tree of the same kind. Runs
are then joined with the runs above them from the top down, so that a bottom run
carries the way to the root once for all its leaves.

Numbers are given in two levels (ranges of the order, then rows of a range), so
neither a large group nor the list of groups is one task's work. Every level is
written to the checkpoint folder; only row counts come to the driver.

Defined results: null fields are written as a dash; a null group is a group,
before all others; null ids come first in their group, and leaves of one id are
ordered by their digest, so repeated rows are neighbours; extra columns are not
looked at; empty tables give an empty result; texts of any length are hashed
whole; a row whose id is null is not tampered with by the query.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut

ARITY = 8
#: What goes into a leaf, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows that are numbered as one range, about.
RANGE_ROWS = 200_000


def encoded(c: Column) -> Column:
    """A value with its length in bytes, or a dash."""
    value = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*map(encoded, values)), 256)


def joined_digest(digests: Column) -> Column:
    """The digest of several digests on end."""
    return F.sha2(F.array_join(digests, ""), 256)


def numbered(df: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """df with idx, a row's number from 0 in its group, and n, the group's rows.

    In two levels: rows are dealt to sorted ranges of (group, order); a row's place in its range comes
    after what the ranges before hold of its group.
    """
    by = [F.col(group), *order]
    parts = max(1 + df.count() // RANGE_ROWS, df.sparkSession.sparkContext.defaultParallelism)
    # the id's upper bits are the range, the lower 33 the place in it; both are written with the row
    ranged = cut(df.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("_id", F.monotonically_increasing_id()))
    ranged = ranged.select(*df.columns, F.shiftright("_id", 33).alias("_part"), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)).alias("_place"))
    own = Window.partitionBy(group)
    sizes = ranged.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_first"))
    before = F.coalesce(F.sum("_n").over(own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(group, "_part", (before - F.col("_first")).alias("_offset"), F.sum("_n").over(own).alias("n"))
    return ranged.join(offsets, [group, "_part"]).select(*df.columns, (F.col("_place") + F.col("_offset")).cast("long").alias("idx"), "n")


def siblings(idx: Column, arity: int) -> Column:
    """Indices of a run's other nodes, seen from its first one."""
    return F.array(idx.bitwiseXOR(F.lit(1))) if arity == 2 else F.array(*[idx + d for d in range(1, arity)])


def runs(nodes: DataFrame, arity: int) -> DataFrame:
    """g, n, run and its nodes in order (an array of slot, digest, rest), a row a run. nodes: g, n, idx, digest, rest."""
    first = nodes.where(F.col("idx") % arity == 0).select("g", "n", F.col("idx").alias("base"))
    wanted = first.select("g", "n", "base", F.explode(F.concat(F.array("base"), siblings(F.col("base"), arity))).alias("idx")).where("idx < n")
    found = wanted.join(nodes.drop("n"), ["g", "idx"])
    node = F.struct((F.col("idx") - F.col("base")).cast("int").alias("slot"), "digest", "rest")
    return found.groupBy("g", "base").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(node)).alias("nodes")).select("g", "n", F.expr(f"base div {arity}").alias("run"), "nodes")


def levels(nodes: DataFrame, arity: int) -> tuple[list[DataFrame], DataFrame]:
    """(runs of each level from the bottom, roots: g, root and the number of levels below it). n: the nodes that a group has at a level; with one it is done."""
    out, roots = [], []
    most = nodes.agg(F.max("n")).first()[0] or 0
    none = F.lit(None).cast(nodes.schema["rest"].dataType)
    while True:
        roots.append(nodes.where("n = 1").select("g", F.col("digest").alias("root"), F.lit(len(out)).alias("height")))
        if most <= 1:
            return out, reduce(DataFrame.unionByName, roots)
        out.append(cut(runs(nodes.where("n > 1"), arity)))
        nodes = out[-1].select("g", F.ceil(F.col("n") / arity).cast("long").alias("n"), F.col("run").alias("idx"), joined_digest(F.col("nodes.digest")).alias("digest"), none.alias("rest"))
        most = -(-most // arity)


STEP = "array<struct<slot:int,digests:array<string>>>"


def _step(run: Column, slot: Column) -> Column:
    """What a node at slot of a run needs to go one level up."""
    return F.array(F.struct(slot.cast("int").alias("slot"), run["digest"].alias("digests"))).cast(STEP)


def ways(built: list[DataFrame], top: DataFrame, arity: int) -> DataFrame:
    """g, nodes of the bottom runs, subroot, and way: for each level above, bottom to top, the slot and the digests of the run there.

    top: g, height, subroot and the way above each group's root.
    """
    above = None
    for level in reversed(range(len(built))):
        last = built[level].where("run = 0").join(top.where(F.col("height") == level + 1), "g")
        rows = last.select("g", "run", "nodes", "subroot", "way")
        if above is not None:
            up = above.select("g", F.col("run").alias("up"), F.col("nodes").alias("up_nodes"), "subroot", "way")
            met = built[level].withColumn("up", F.expr(f"run div {arity}")).join(up, ["g", "up"])
            rows = rows.unionByName(met.select("g", "run", "nodes", "subroot", F.concat(_step(F.col("up_nodes"), F.col("run") % arity), "way").alias("way")))
        above = rows
    return above


def others(way: Column) -> Column:
    """The siblings along a way, level by level, left to right."""
    return F.flatten(F.transform(way, lambda s: F.filter(s["digests"], lambda _, i: i != s["slot"])))


def folded(digest: Column, way: Column) -> Column:
    """The root that a leaf's digest and the siblings along its way give."""
    put = lambda acc, s: joined_digest(F.transform(s["digests"], lambda d, i: F.when(i == s["slot"], acc).otherwise(d)))
    return F.aggregate(way, digest, put)


def tree(leaves: DataFrame, arity: int = ARITY) -> DataFrame:
    """leaf, subroot, root, way and rest, a row a leaf. leaves: g (the group's name, never null), order, leaf, rest.

    way holds, for each level of the group's tree and then of the tree above the groups, the slot and
    the digests of the run that a leaf's way to the root goes through.
    """
    nodes = cut(numbered(leaves, "g", [F.col("order").asc_nulls_first(), F.col("leaf")]).select("g", "n", "idx", F.col("leaf").alias("digest"), "rest"))
    built, roots = levels(nodes, arity)
    roots = cut(roots)
    subroots = numbered(roots.select(F.lit("").alias("g"), F.col("g").alias("rest"), F.col("root").alias("digest"), "height"), "g", [F.col("rest")])
    top_nodes = cut(subroots.select("g", "n", "idx", "digest", F.struct(F.col("rest").alias("g"), "height").alias("rest")))
    top_built, top_roots = levels(top_nodes, arity)
    root = top_roots.first()
    none = F.array().cast(STEP)
    only = top_nodes.where("n = 1").select("rest.g", "rest.height", F.col("digest").alias("subroot"), none.alias("way"))
    if top_built:
        start = top_roots.select("g", "height", F.col("root").alias("subroot"), none.alias("way"))
        only = only.unionByName(ways(top_built, start, arity).select("nodes", "way", F.explode("nodes").alias("node")).select("node.rest.g", "node.rest.height", F.col("node.digest").alias("subroot"), F.concat(_step(F.col("nodes"), F.col("node.slot")), "way").alias("way")))
    top = cut(only)
    out = nodes.where("n = 1").join(top, "g").select(F.col("digest").alias("leaf"), "subroot", "way", "rest")
    if built:
        runs_up = ways(built, top, arity).select("nodes", "subroot", "way", F.explode("nodes").alias("node"))
        out = out.unionByName(runs_up.select(F.col("node.digest").alias("leaf"), "subroot", F.concat(_step(F.col("nodes"), F.col("node.slot")), "way").alias("way"), "node.rest"))
    return out.withColumn("root", F.lit(root["root"] if root else None).cast("string"))


def manifest(docs: DataFrame, id: str = "doc_id", group: str = "lang", fields: tuple[str, ...] = FIELDS, arity: int = ARITY, tampered: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, way and tampered_leaf, a row a row of docs.

    tampered: the digest that a leaf is found to have later; null (or None) where it is as it was.
    """
    later = F.lit(None).cast("string") if tampered is None else tampered
    # a null group's name sorts before those of all others
    name = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-"))
    leaves = cut(docs.select(name.alias("g"), F.col(id).alias("order"), leaf_digest(*[F.col(c) for c in fields]).alias("leaf"), F.struct(F.col(id).alias("id"), later.alias("later")).alias("rest")))
    return tree(leaves, arity).select(F.col("rest.id").alias("doc_id"), "leaf", "subroot", "root", "way", F.col("rest.later").alias("tampered_leaf"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: every document's leaf, proof and whether the leaf as found later still leads to the root."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    changed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, leaf_digest(*[text if c == "text" else F.col(c) for c in FIELDS]))
    out = manifest(docs, tampered=changed)
    return out.select(
        "doc_id", "leaf", "subroot", "root", joined_digest(others(F.col("way"))).alias("proof_sha256"),
        folded(F.coalesce("tampered_leaf", "leaf"), F.col("way")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))

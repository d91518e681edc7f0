"""Quality rules by weak supervision (DataFrame operations only).

Each rule votes good (1), bad (-1) or abstains (null). Documents with the same
votes are counted together, so the model is fitted on at most 3 to the number
of rules patterns, over all documents. Expectation-maximisation estimates the
share of good documents and each rule's accuracy on good and on bad ones; a
document's verdict is the posterior probability of being good, not a demand
that every rule passes.

Defined results: a null or empty text has no words and fails the base rule;
null and repeated ids are ordinary rows; a document on which all rules
abstain gets the prior; an empty table gives an empty result.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE, cut, words_of

#: Words in a window that may repeat in a text.
WINDOW = 8
#: Rounds of expectation-maximisation at most; fewer if no accuracy moves by more than the tolerance.
ROUNDS, TOLERANCE = 25, 1e-4
# Frequent short words of English, German, French and Spanish.
COMMON = ("the", "of", "and", "to", "in", "is", "that", "it", "for", "was", "der", "die", "und", "das", "den", "von", "zu", "mit", "ein", "nicht", "le", "la", "les", "de", "des", "et", "un", "une", "du", "en", "que", "el", "los", "las", "y", "se", "por", "con", "para", "del")


def features(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Counts of each whole text: those of the base, and n_lines, n_upper, n_letters, n_common, n_bare (words without letters or digits), n_ended (lines that end a sentence)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    only = lambda kept: F.length(F.regexp_replace(text, f"[^{kept}]+", "")).cast("long")
    split = docs.select("doc_id", *keep, text.alias("text"), words_of(F.col("text")).alias("words"))
    # a window's hash stands for its words: within a text 64 bits do
    staged = split.select(
        "*",
        F.when(F.size("words") >= WINDOW, F.transform(F.sequence(F.lit(1), F.size("words") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("words", i, F.lit(WINDOW))))).otherwise(F.array().cast("array<long>")).alias("w"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    # words covered by windows that occur twice or more: sort by hash, take those equal to a neighbour, add up the gaps between their starts
    sorted_ = staged.withColumn("by_hash", F.when(F.size(F.array_distinct("w")) < F.size("w"), F.array_sort(F.transform("w", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twice = lambda x, i: (F.get("by_hash", i - 1)["h"] == x["h"]) | (F.get("by_hash", i + 1)["h"] == x["h"])
    starts = sorted_.withColumn("starts", F.array_sort(F.transform(F.filter("by_hash", lambda x, i: F.coalesce(twice(x, i), F.lit(False))), lambda x: x["i"])))
    covered = F.aggregate(F.zip_with("starts", F.slice("starts", 2, F.size("starts")), lambda a, b: F.coalesce(F.least(F.lit(WINDOW), b - a), F.lit(WINDOW))), F.lit(0), lambda a, x: a + x)
    return starts.select(
        "doc_id", *keep,
        F.size("words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", SPACE, "")).cast("long").alias("word_chars"),
        only(r"#*$%&|<>").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("starts") > 0, covered).otherwise(0).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        only("A-Z").alias("n_upper"),
        only("A-Za-z").alias("n_letters"),
        F.size(F.filter("words", lambda x: F.lower(x).isin(*COMMON))).cast("long").alias("n_common"),
        F.size(F.filter("words", lambda x: ~x.rlike(r"[\p{L}\p{N}]"))).cast("long").alias("n_bare"),
        F.size(F.filter("lines", lambda x: x.rlike(r"[.!?][\x20\x09-\x0D]*$"))).cast("long").alias("n_ended"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def rules() -> dict[str, Column]:
    """Each rule's vote over the columns of features."""
    words = F.greatest("n_words", F.lit(1))
    vote = lambda bad, good: F.when(bad, -1).when(good, 1)
    per_word = lambda c: F.col(c) / words
    shouting = F.col("n_upper") / F.greatest("n_letters", F.lit(1))
    length = F.col("word_chars") / words
    return {
        "long_enough": vote(F.col("n_words") < 20, F.col("n_words") >= 50),
        "few_symbols": vote(per_word("n_symbols") > 0.1, per_word("n_symbols") < 0.02),
        "not_repeated": vote(per_word("n_repeat_words") > 0.2, per_word("n_repeat_words") < 0.05),
        "lines_differ": vote(F.col("n_dup_lines") > 0.3 * F.col("n_lines"), F.col("n_dup_lines") == 0),
        "not_shouting": vote(shouting > 0.4, shouting < 0.15),
        "word_length": vote((length > 12) | (length < 2.5), length.between(3.0, 9.0)),
        "common_words": vote(per_word("n_common") < 0.04, per_word("n_common") > 0.12),
        "few_bare": vote(per_word("n_bare") > 0.1, F.col("n_bare") == 0),
        "sentences": vote(F.col("n_ended") < 0.3 * F.col("n_lines"), F.col("n_ended") > 0.7 * F.col("n_lines")),
    }


def fit(votes: DataFrame, names: list[str], rounds: int = ROUNDS) -> dict:
    """The prior of good and each rule's accuracies (on good, on bad), from all rows' votes.

    One row a pattern is kept and one row of sums a round comes to the driver. Counts are smoothed by
    one vote each way, so a rule that never votes keeps accuracy one half.
    """
    patterns = cut(votes.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).coalesce(1).sortWithinPartitions(*names))
    model = {"prior": 0.8, "good": dict.fromkeys(names, 0.8), "bad": dict.fromkeys(names, 0.8)}
    for _ in range(rounds):
        rows = patterns.withColumn("p", posterior(model))
        g, b = F.col("n") * F.col("p"), F.col("n") * (1 - F.col("p"))
        sums = [F.sum(F.when(c, x)).alias(f"{k}{i}") for i, v in enumerate(names) for k, x, c in (("gv", g, F.col(v).isNotNull()), ("gr", g, F.col(v) == 1), ("bv", b, F.col(v).isNotNull()), ("br", b, F.col(v) == -1))]
        s = rows.agg(F.sum("n").alias("n"), F.sum(g).alias("g"), *sums).first()
        if not s["n"]:
            break
        rate = lambda k, i: ((s[f"{k}r{i}"] or 0) + 1) / ((s[f"{k}v{i}"] or 0) + 2)  # noqa: B023, E731
        before, model = model, {"prior": (s["g"] + 1) / (s["n"] + 2), "good": {v: rate("g", i) for i, v in enumerate(names)}, "bad": {v: rate("b", i) for i, v in enumerate(names)}}
        if max(abs(x - y) for k in ("good", "bad") for x, y in zip(model[k].values(), before[k].values())) < TOLERANCE:
            break
    return model


def posterior(model: dict) -> Column:
    """Probability of good, given the votes in the columns that the model names: independent rules, abstentions say nothing."""
    odds = F.lit(log(model["prior"] / (1 - model["prior"])))
    for v, a in model["good"].items():
        b = model["bad"][v]
        odds = odds + F.when(F.col(v) == 1, log(a / (1 - b))).when(F.col(v) == -1, log((1 - a) / b)).otherwise(0.0)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))


def judge(docs: DataFrame, keep: tuple[str, ...] = (), least: float = 0.5) -> DataFrame:
    """A row a document: doc_id, columns in keep, the counts, each rule's vote, p_good, base_failed, kept."""
    voted = cut(features(docs, keep).withColumns(rules()))
    model = fit(voted, list(rules()))
    return voted.withColumn("p_good", posterior(model)).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= least))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: counts and verdict of every document."""
    out = judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("p_good", 6).alias("p_good"))

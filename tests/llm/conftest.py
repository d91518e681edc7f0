import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside; they must not be confused with columns of the input.
CLASHING = ("id", "hash", "size", "copy", "fp", "words", "removed", "n_removed", "text_hash", "target", "position", "score", "kept", "row_no", "window", "bucket", "line", "component")


def passage(rng, n, stem=""):
    return " ".join(stem + "".join(rng.choice(["ba", "ke", "lo", "mi", "nu", "ra", "so", "ti"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def make_rows():
    """Small documents with every odd case: nulls, empty and long texts, exact and near copies, repeated rows, shared passages."""
    rng = random.Random(4)
    shared, long_line = passage(rng, 60), passage(rng, 80)
    words = long_line.split()
    near = [" ".join([*words[:i], "x", *words[i + 1 :]]) for i in (3, 40, 77)]
    rows = [(i, passage(rng, rng.randint(5, 90)) + "\n" + passage(rng, 30), "en", f"src{i % 3}", 1) for i in range(30)]
    rows += [(30, "start " + shared + " end", "en", "src0", 1), (31, shared.upper() + " " + shared, "en", "src1", 1), (32, "other " + shared, "en", None, 1)]
    rows += [(33 + i, t, "en", "src1", 1) for i, t in enumerate([long_line, *near, long_line])]
    rows += [(40, None, None, None, None), (41, "", "en", "src2", 0), (42, " \n\t ", "en", "src2", 3), (43, "one", "en", "src2", 3), (None, "no id here " + shared, "en", "src0", 1), (None, None, None, "src0", None)]
    rows += [(44, "same row\nsame row", "en", "src0", 1)] * 2 + [(45, "é" * 30 + " " + passage(rng, 3000), "fr", "src2", 1), (46, "aaaa " * 200, "en", "src2", 1), (-5, shared, "en", "src1", 1)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows, tmp_path_factory):
    from pyspark.sql import functions as F

    at = str(tmp_path_factory.mktemp("docs") / "d")
    spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in CLASHING}).repartition(3).write.parquet(at)
    return spark.read.parquet(at)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)

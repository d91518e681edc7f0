"""Fill-in-the-middle transformation with a learned rank index over token boundaries.

A block of texts is one sequence of token boundaries: rank to byte offset. The
index keeps this mapping as straight segments whose error stays below a bound,
and what the segments miss as residuals of a byte or two each. A cut at a rank
is predicted by its segment and corrected exactly by the stored residual.

Defined results: a null or empty text is plain, with 0 tokens; a null id draws
its numbers from the empty text after the salt's colon; repeated rows are cut
alike; texts that hold a sentinel stay plain; texts of any length are whole,
one at a time if they are longer than a block; extra columns are not looked at
unless they are named in ``keep``; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import text_bytes

# The sentinels of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SENTINEL = "<P>|<S>|<M>"
#: Largest error of a segment in bytes: a residual is one signed byte.
ERROR = 127
#: Bytes of text that are indexed together, about.
BLOCK = 1 << 20
#: Boundaries that a segment is tried on first; the number grows while the segment holds.
FIRST = 1024

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


@dataclass(frozen=True)
class RankIndex:
    """Segments (first rank, first offset, slope) and the residual of every rank."""

    ranks: np.ndarray
    offsets: np.ndarray
    slopes: np.ndarray
    residuals: np.ndarray

    def predict(self, rank: np.ndarray) -> np.ndarray:
        """Offsets by the segments alone."""
        at = np.searchsorted(self.ranks, rank, side="right") - 1
        return self.offsets[at] + np.rint(self.slopes[at] * (rank - self.ranks[at])).astype(np.int64)

    def find(self, rank: np.ndarray) -> np.ndarray:
        """Exact offsets."""
        return self.predict(rank) + self.residuals[rank]


def fit(offsets: np.ndarray, error: int = ERROR, first: int = FIRST) -> RankIndex:
    """Error-bounded segments over increasing offsets, each as long as some slope through its first point serves.

    A slope serves up to a rank if it lies in the cone that all points before leave open; cones are
    running maxima and minima over pieces that double while the segment goes on.
    """
    n, start, most = len(offsets), 0, float(error)
    ranks, firsts, slopes, missed = [], [], [], []
    while start < n:
        low, high, end, size = 0.0, np.inf, start + 1, first
        while end < n:
            piece = np.arange(end, min(n, end + size))
            rise, run = (offsets[piece] - offsets[start]).astype(float), piece - start
            lows = np.maximum(np.maximum.accumulate((rise - most + 0.5) / run), low)
            highs = np.minimum(np.minimum.accumulate((rise + most - 0.5) / run), high)
            shut = lows > highs
            held = int(shut.argmax()) if shut.any() else len(piece)
            if held:
                low, high = lows[held - 1], highs[held - 1]
            end += held
            if held < len(piece):
                break
            size *= 2
        slope = low if high == np.inf else (low + high) / 2
        ranks.append(start)
        firsts.append(int(offsets[start]))
        slopes.append(slope)
        missed.append(offsets[start:end] - offsets[start] - np.rint(slope * np.arange(end - start)).astype(np.int64))
        start = end
    residuals = np.concatenate(missed) if missed else np.zeros(0, np.int64)
    return RankIndex(np.array(ranks, np.int64), np.array(firsts, np.int64), np.array(slopes, float), residuals.astype(np.int8 if error < 128 else np.int32))


def boundaries(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(byte offset of every token's start and, last, of the end; each text's first rank, with the end; code points before each byte).

    Tokens are runs of letters A-Z, a-z and single other code points; at has the texts' starts and the end.
    """
    letter, point = _LETTER[data], (data & 0xC0) != 0x80
    start = point.copy()
    start[1:] &= ~(letter[1:] & letter[:-1])
    start[at[:-1][at[:-1] < len(data)]] = True  # a text begins a token, whatever the one before ends with
    offsets = np.append(np.flatnonzero(start), len(data))
    return offsets, np.searchsorted(offsets, at), np.concatenate([[0], np.cumsum(point)])


def _blocks(at: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about size bytes; longer texts stand alone."""
    first = 0
    while first < len(at) - 1:
        last = max(first + 1, int(np.searchsorted(at, at[first] + size, side="right")) - 1)
        yield first, last
        first = last


def cut_texts(column: pa.Array, draws: np.ndarray, plain_share: int, spm_share: int, error: int, block: int) -> tuple[np.ndarray, list[str], np.ndarray, list[bytes]]:
    """(tokens, form, code points of prefix and middle (-1 if plain), output) of each text; draws: four numbers a text."""
    data, at = text_bytes(column)
    n, forms, chars, outputs = np.zeros(len(at) - 1, np.int64), [], np.full((len(at) - 1, 2), -1, np.int64), []
    for first, last in _blocks(at, block):
        part, starts = data[at[first] : at[last]], at[first : last + 1] - at[first]
        offsets, ranks, points = boundaries(part, starts)
        index = fit(offsets, error)
        n[first:last] = np.diff(ranks)
        two = np.sort(draws[first:last, :2] % (n[first:last, None] + 1), axis=1)
        cuts = index.find(ranks[:-1, None] + two)
        raw = part.tobytes()
        for i in range(last - first):
            a, b, c, d = int(starts[i]), int(cuts[i, 0]), int(cuts[i, 1]), int(starts[i + 1])
            text, (_, _, h3, h4) = raw[a:d], draws[first + i]
            if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or h3 % 100 >= plain_share:
                forms.append("plain")
                outputs.append(text)
                continue
            prefix, middle, suffix = raw[a:b], raw[b:c], raw[c:d]
            chars[first + i] = points[b] - points[a], points[c] - points[b]
            if h4 % 100 < spm_share:
                forms.append("spm")
                outputs.append(b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle)))
            else:
                forms.append("psm")
                outputs.append(b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle)))
    return n, forms, chars, outputs


def transform(docs: DataFrame, id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), salt: str = "1", plain_share: int = 90, spm_share: int = 20, error: int = ERROR, block: int = BLOCK) -> DataFrame:
    """id, n, form, prefix_chars, middle_chars, output and the columns in keep, a row a text.

    plain_share: texts of a hundred that are cut; spm_share: of those, the ones with the suffix first.
    """
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col(id).cast("string"), F.lit(""))), 256)
    draws = F.array(*[F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)])
    picked = docs.select(F.col(id).alias("_tm_id"), *[F.col(c).alias(f"_tm_keep{i}") for i, c in enumerate(keep)], F.col(text).alias("_tm_text"), draws.alias("_tm_draws"))
    carried = [c for c in picked.columns if c not in ("_tm_text", "_tm_draws")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, drawn = batch.column("_tm_text"), np.asarray(batch.column("_tm_draws").flatten()).reshape(-1, 4)
            _, ends = text_bytes(texts)
            for first, last in _blocks(ends, 8 * block):  # what goes back is of bounded size too
                n, forms, chars, outputs = cut_texts(texts.slice(first, last - first), drawn[first:last], plain_share, spm_share, error, block)
                none = chars[:, 0] < 0
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(first, last - first) for c in carried), pa.array(n), pa.array(forms, pa.string()), pa.array(chars[:, 0], mask=none), pa.array(chars[:, 1], mask=none), pa.array(outputs, pa.binary()).cast(pa.string())],
                    names=[*carried, "_tm_n", "_tm_form", "_tm_prefix", "_tm_middle", "_tm_output"],
                )

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in picked.schema if f.name in carried)
    out = picked.mapInArrow(run, f"{kinds}, _tm_n long, _tm_form string, _tm_prefix long, _tm_middle long, _tm_output string")
    names = {"_tm_id": id, "_tm_n": "n", "_tm_form": "form", "_tm_prefix": "prefix_chars", "_tm_middle": "middle_chars", "_tm_output": "output"} | {f"_tm_keep{i}": c for i, c in enumerate(keep)}
    return out.select(*[F.col(k).alias(v) for k, v in names.items()])


def restore(output: Column, form: Column) -> Column:
    """The text that an output was made of."""
    part = F.split(output, SENTINEL)
    at = lambda *order: F.concat(*[F.get(part, F.lit(i)) for i in order])
    return F.when(form == "psm", at(1, 3, 2)).when(form == "spm", at(2, 3, 1)).otherwise(output)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: the digest of the transformation of all documents."""
    out = transform(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


ORACLE_SQL = r"""
WITH h AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
u AS (
  SELECT *, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS tokens,
    CAST('0x' || x[1:8] AS BIGINT) AS h1, CAST('0x' || x[9:16] AS BIGINT) AS h2, CAST('0x' || x[17:24] AS BIGINT) AS h3, CAST('0x' || x[25:32] AS BIGINT) AS h4
  FROM h),
c AS (
  SELECT *, CAST(len(tokens) AS BIGINT) AS n, least(h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)) AS a, greatest(h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)) AS b
  FROM u),
p AS (
  SELECT doc_id, t, n,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
    coalesce(array_to_string(tokens[1:a], ''), '') AS prefix, coalesce(array_to_string(tokens[a + 1:b], ''), '') AS middle, coalesce(array_to_string(tokens[b + 1:], ''), '') AS suffix
  FROM c)
SELECT doc_id, n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""

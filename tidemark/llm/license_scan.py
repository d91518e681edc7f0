"""License scans: exact phrases, and short notices with a bounded number of errors.

A notice of n characters may differ in k = n // ERROR_EVERY edits. Cut into
k + 1 pieces, at least one piece of any such occurrence is unchanged
(pigeonhole), so an Aho-Corasick pass over the normalised text for all pieces
of all notices finds every candidate place. Each candidate is verified on its
own by the regex library's fuzzy matching, best match within the stretch that
the piece allows; of overlapping places of a notice the one with fewest edits
stays, of equal ones the first. The words that make a notice what it is (KEYS)
are no room for errors: short ones and numbers must stand there as they are,
longer ones with one edit at most. Nor is a negation (NEGATIONS): a place with
one that the notice itself doesn't have says something else.

Defined results: a null text counts as empty; an empty table gives an empty
result; texts of any length are searched whole, in time linear in their length
but for their candidate places; a text without words has no
places, null first and last words, empty labels and score 0; ids are carried
as they are, null and repeated ones included; extra columns are not looked at.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

# Phrases that are looked for as they stand, with their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Public notices, as words, with their labels.
NOTICES = {
    "licensed under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the apache license version 2 0": "apache-2",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "this work is licensed under the gnu general public license version 3": "gpl-3",
    "gnu lesser general public license as published by the free software foundation": "lgpl",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "subject to the terms of the mozilla public license v 2 0": "mpl-2",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "licensed under a creative commons attribution sharealike 4 0 international license": "cc-by-sa",
    "to the extent possible under law the author has waived all copyright": "cc0",
}
# The words of a notice that other licenses do not share or that carry what it grants, in their order.
KEYS = {
    "licensed under the mit license": ("mit",),
    "permission is hereby granted free of charge to any person obtaining a copy": ("permission", "granted", "charge", "obtaining"),
    "licensed under the apache license version 2 0": ("apache", "2"),
    "licensed under cc by nc 4 0": ("cc", "by", "nc", "4"),
    "this work is licensed under the gnu general public license version 3": ("gnu", "general", "3"),
    "gnu lesser general public license as published by the free software foundation": ("gnu", "lesser", "general"),
    "redistribution and use in source and binary forms with or without modification are permitted": ("redistribution", "binary", "modification", "permitted"),
    "subject to the terms of the mozilla public license v 2 0": ("mozilla", "2"),
    "permission to use copy modify and or distribute this software for any purpose": ("permission", "modify", "distribute", "purpose"),
    "this is free and unencumbered software released into the public domain": ("unencumbered", "released", "public", "domain"),
    "licensed under a creative commons attribution sharealike 4 0 international license": ("creative", "commons", "attribution", "sharealike", "4"),
    "to the extent possible under law the author has waived all copyright": ("extent", "author", "waived", "copyright"),
}
# Words that turn a notice round.
NEGATIONS = frozenset(("not", "no", "never", "nor", "neither", "cannot", "except", "isn", "aren", "hasn", "doesn", "don"))
#: Key words up to this length have to match exactly.
SHORT = 4
#: One edit is allowed for so many characters of a notice.
ERROR_EVERY = 12
_SPACED = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def normal(text: str | None) -> str:
    """The words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text, A-Z lower-cased, joined by single spaces."""
    return b" ".join((text or "").encode().lower().translate(_SPACED).split()).decode()


@cache
def _search(notices: tuple[tuple[str, str, tuple[str, ...]], ...], every: int = ERROR_EVERY):
    """The automaton over all pieces, and each notice's length, edits, label, pattern, the patterns of its keys, and its negations. notices: words, label, keys."""
    automaton, known, pieces = ahocorasick.Automaton(), [], {}
    for words, label, keys in notices:
        k = max(1, len(words) // every)
        cuts = [len(words) * i // (k + 1) for i in range(k + 2)]
        for a, b in zip(cuts, cuts[1:]):
            pieces.setdefault(words[a:b], []).append((len(known), a, b - a))
        patterns = [regex.compile(rf"\b{w}\b" if len(w) <= SHORT else rf"(?b)\b(?:{w}){{e<=1}}\b") for w in keys]
        known.append((len(words), k, label, regex.compile(f"(?b)(?:{regex.escape(words, literal_spaces=True)}){{e<={k}}}"), patterns, sum(w in NEGATIONS for w in words.split())))
    for piece, places in pieces.items():
        automaton.add_word(piece, places)
    automaton.make_automaton()
    return automaton, known


def _listed(notices: dict[str, str] | None, keys: dict[str, tuple[str, ...]] | None) -> tuple[tuple[str, str, tuple[str, ...]], ...]:
    """Notices in normalised words, with their labels and keys; the built-in ones by default."""
    if notices is None:
        notices, keys = NOTICES, KEYS if keys is None else keys
    out = tuple((normal(words), label, tuple(map(normal, (keys or {}).get(words, ())))) for words, label in notices.items())
    if lost := [w for w, _, k in out if not w or any(x not in w.split() for x in k)]:
        raise ValueError(f"a notice has no words, or keys that it doesn't hold: {lost[0]!r}")
    return out


def _holds(words: str, start: int, end: int, keys: list) -> bool:
    """Whether the words from start to end hold the keys in order."""
    for key in keys:
        m = key.search(words, start, end)
        if not m:
            return False
        start = m.end()
    return True


def fuzzy_notices(words: str, gaps: list[int] | None = None, listed: tuple = _listed(None, None)) -> list[tuple[str, int, int, int, int]]:
    """(label, first word, last word, edits, characters) of the notices in normalised text, in order; of overlapping places of a notice the best. gaps: where the spaces are."""
    automaton, notices = _search(listed)
    windows: dict[int, set[int]] = {}
    for end, places in automaton.iter(words):
        for no, offset, size in places:
            windows.setdefault(no, set()).add(end + 1 - size - offset)
    if not windows:
        return []
    gaps = [m.start() for m in regex.finditer(" ", words)] if gaps is None else gaps
    found = set()
    for no, starts in windows.items():
        length, k, label, pattern, keys, negations = notices[no]
        places = set()
        for at in starts:
            m = pattern.search(words, max(0, at - k), min(len(words), at + length + k))
            if m:
                s, e = m.span()
                s, e = s + len(m[0]) - len(m[0].lstrip()), e - (len(m[0]) - len(m[0].rstrip()))
                first, last = bisect_left(gaps, s + 1), bisect_left(gaps, e)
                whole = (gaps[first - 1] + 1 if first else 0), (gaps[last] if last < len(gaps) else len(words))
                if s < e and _holds(words, *whole, keys) and sum(w in NEGATIONS for w in words[slice(*whole)].split()) <= negations:
                    places.add((sum(m.fuzzy_counts), s, e, first, last))
        taken: list[tuple[int, int]] = []  # apart from each other, in order
        for edits, s, e, first, last in sorted(places):
            i = bisect_left(taken, (s, e))
            if (i == len(taken) or e <= taken[i][0]) and (i == 0 or taken[i - 1][1] <= s):
                taken.insert(i, (s, e))
                found.add((label, first, last, edits, e - s))
    return sorted(found, key=lambda x: (x[1], x[2], x[0]))


def exact_phrases(words: str, gaps: list[int] | None = None) -> list[tuple[str, int]]:
    """(label, word number) of every place where a phrase's words stand; places may overlap."""
    places, spaced = [], f" {words} "
    for phrase, label in PHRASES.items():
        at = spaced.find(f" {phrase} ")
        while at >= 0:
            gaps = [m.start() for m in regex.finditer(" ", words)] if gaps is None else gaps
            places.append((label, bisect_left(gaps, at)))
            at = spaced.find(f" {phrase} ", at + 1)
    return places


def scan_text(text: str | None, listed: tuple = _listed(None, None)) -> tuple:
    words = normal(text)
    base, more = exact_phrases(words), fuzzy_notices(words, listed=listed)
    labels = {x[0] for x in base}
    starts = [x[1] for x in base]
    score = 1.0 if base else max((1 - x[3] / max(x[4], 1) for x in more), default=0.0)
    return (
        words.count(" ") + 1 if words else 0, len(base), min(starts, default=None), max(starts, default=None),
        ",".join(sorted(labels)), ",".join(sorted(labels | {x[0] for x in more})), max(0.0, min(1.0, score)),
        [{"label": x[0], "first_word": x[1], "last_word": x[2], "edits": x[3]} for x in more],
    )


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, notices array<struct<label:string,first_word:long,last_word:long,edits:long>>"
_NAMES = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "notices")
_TYPES = (*[pa.int64()] * 4, pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int64())])))


def licenses(docs: DataFrame, notices: dict[str, str] | None = None, keys: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """A row a document: doc_id, the counts, labels and score, and the notices with spans (in words) and edits.

    notices: words and label of what is searched for with errors (NOTICES by default); keys: words of a notice that have to be there.
    """
    listed = _listed(notices, keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [scan_text(t.as_py(), listed) for t in batch.column("text")]
            columns = list(zip(*rows)) or [()] * len(_NAMES)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(list(c), t) for c, t in zip(columns, _TYPES))], names=["doc_id", *_NAMES])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {SCHEMA}")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: the scan of all documents."""
    return licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""License scan: exact phrases, and fuzzy search for short notices.

Texts are read as words (letters and digits, A-Z lower-cased) joined by single spaces. A phrase counts at every place
where its words stand consecutively. A notice may differ from the text by up to its number of edits k: it is cut into
k + 1 pieces, at least one of which then stands in the text as it is; all pieces are found in one pass, and around
each the regex library's bounded-error matching verifies the notice between word ends and reports span and edits.
Clauses and versions must stand exactly, with none added; edits are for the other words.

Cases: null and empty texts have no words, no labels and score 0; a text of any length is read whole; a notice that
occurs many times gives a span each time; of spans that overlap the one with the fewest edits stays, of equals the
longest, then the first; other columns are never looked at.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Phrases that must stand exactly, and their labels; fixed values.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Notices that are searched with edits, and their labels.
NOTICES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the apache license version 2 0": "apache-2",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under cc by 4 0": "cc-by",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution sharealike": "cc-by-sa",
    "licensed under the gnu general public license version 3": "gpl-3",
    "licensed under the gnu general public license version 2": "gpl-2",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license version 2 0": "mpl-2",
    "redistribution and use in source and binary forms": "bsd",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "all rights reserved": "proprietary",
}
#: Clauses of a licence, which must stand as they are in a notice, as versions must.
CLAUSES = {"cc", "by", "nc", "nd", "sa"}
#: Letters of a notice for each edit allowed, and the most edits.
LETTERS_PER_EDIT, MOST_EDITS = 8, 4


def edits(notice: str) -> int:
    return max(1, min(MOST_EDITS, len(notice) // LETTERS_PER_EDIT))


def pieces(notice: str) -> list[tuple[int, str]]:
    """(offset, piece) of the k + 1 pieces."""
    n = edits(notice) + 1
    cuts = [len(notice) * i // n for i in range(n + 1)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


@cache
def _seeds():
    import ahocorasick

    found: dict[str, list] = {}
    for notice in NOTICES:
        for offset, piece in pieces(notice):
            found.setdefault(piece, []).append((notice, offset))
    automaton = ahocorasick.Automaton()
    for piece, where in found.items():
        automaton.add_word(piece, (len(piece), where))
    automaton.make_automaton()
    return automaton


@cache
def _pattern(notice: str):
    return regex.compile(rf"(?<=\s)(?:{regex.escape(notice, literal_spaces=True)}){{e<={edits(notice)}}}(?=\s)", regex.BESTMATCH)


def decisive(words: list[str]) -> list[str]:
    """The words that tell licences of one family apart: clauses, and versions and other words with a digit."""
    return [w for w in words if w in CLAUSES or any(c.isdigit() for c in w)]


def fuzzy_spans(joined: str) -> list[tuple[str, int, int, int]]:
    """(notice, start, end, edits) in a text of words with a space before, between and after them.

    Each seed is verified in a window of its own, as long as the notice and its edits, so the work grows with the seeds.
    """
    windows = set()
    for end, (size, where) in _seeds().iter(joined):
        for notice, offset in where:
            k, begin = edits(notice), end + 1 - size - offset
            windows.add((notice, max(0, begin - k - 1), min(len(joined), begin + len(notice) + k + 1)))
    out = set()
    for notice, low, high in windows:
        m = _pattern(notice).search(joined, low, high)
        if m and m.end() > m.start() and decisive(m[0].split()) == decisive(notice.split()):
            out.add((notice, m.start(), m.end(), sum(m.fuzzy_counts)))
    return _best(sorted(out, key=lambda s: (s[1], s[2], s[0])))


def _best(spans: list[tuple[str, int, int, int]]) -> list[tuple[str, int, int, int]]:
    """Of spans sorted by start, those that no better one overlaps."""
    kept, at = [], 0
    while at < len(spans):
        end, stop = spans[at][2], at + 1
        while stop < len(spans) and spans[stop][1] < end:
            end, stop = max(end, spans[stop][2]), stop + 1
        mine = []
        for span in sorted(spans[at:stop], key=lambda s: (s[3], s[1] - s[2], s[1], s[0])):
            if all(span[2] <= s[1] or s[2] <= span[1] for s in mine):
                mine.append(span)
        kept += sorted(mine, key=lambda s: s[1])
        at = stop
    return kept


def scan(text: str | None) -> dict:
    """Counts, labels and spans of one whole text; span places are words."""
    words = WORD.findall((text or "").translate(UPPER))
    joined = f" {' '.join(words)} "
    heads = list(accumulate((len(w) + 1 for w in words), initial=1))  # where each word begins
    starts, base = [], set()
    for phrase, label in PHRASES.items():
        at = joined.find(f" {phrase} ")
        while at >= 0:
            starts.append(bisect_left(heads, at + 1))
            base.add(label)
            at = joined.find(f" {phrase} ", at + 1)
    spans = []
    for notice, start, end, wrong in fuzzy_spans(joined):
        first = bisect_right(heads, start) - 1
        spans.append({"label": NOTICES[notice], "first": first, "last": bisect_right(heads, end - 1) - 1, "edits": wrong, "score": 1 - wrong / len(notice)})
    labels = base | {s["label"] for s in spans}
    return {
        "n_words": len(words),
        "n_base": len(starts),
        "first_word": min(starts, default=None),
        "last_word": max(starts, default=None),
        "base_labels": ",".join(sorted(base)),
        "labels": ",".join(sorted(labels)),
        "score": 1.0 if starts else max((s["score"] for s in spans), default=0.0),
        "spans": [(s["label"], s["first"], s["last"], s["edits"]) for s in spans],
    }


RESULT = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first:long,last:long,edits:int>>"


def scan_column(docs: DataFrame) -> Column:
    """RESULT of docs.text, as a column."""
    common.small_batches(docs.sparkSession)

    @F.pandas_udf(RESULT)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = pd.DataFrame([scan(t) for t in texts], columns=[c.split()[0] for c in RESULT.split(", ")])
            for c in ("first_word", "last_word"):
                rows[c] = rows[c].astype("Int64")
            yield rows

    return run(docs["text"].cast("string"))

"""License notices: exact phrases, and short notices with a bounded number of errors.

Fuzzy search is by the pigeonhole principle. A notice that may carry k errors is cut into k + 1 pieces; whatever
matches it within k edits holds one piece unchanged. An Aho-Corasick automaton finds the pieces of all notices in one
pass; each hit gives a window of the text in which the notice must lie, and the regex library's bounded-error matching
decides there and gives the span and the number of edits.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from strongroom.llm.common import map_texts

# The exact phrases and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
# A word in lower-cased UTF-8: digits, a to z and everything beyond ASCII.
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[48:58] = WORD_BYTE[97:123] = WORD_BYTE[128:] = True
_CLASS = rb"0-9a-z\x80-\xff"
_PHRASE = re.compile(
    b"(?<![" + _CLASS + b"])(?:"
    + b"|".join(b"(" + (b"[^" + _CLASS + b"]+").join(p.encode().split()) + b")" for p, _ in PHRASES)
    + b")(?![" + _CLASS + b"])"
)

MATCH = T.StructType(
    [
        T.StructField("notice", T.StringType(), False),
        T.StructField("start", T.IntegerType(), False),
        T.StructField("end", T.IntegerType(), False),
        T.StructField("edits", T.IntegerType(), False),
    ]
)


@dataclass(frozen=True)
class Notice:
    """A short notice in lower case, the label it gives, and the errors (code points) it may carry."""

    label: str
    text: str
    errors: int


# Errors are about a tenth of the length.
NOTICES = (
    Notice("apache-2.0", "licensed under the apache license, version 2.0", 4),
    Notice("gpl-3.0", "licensed under the gnu general public license, version 3", 5),
    Notice("gpl-2.0", "licensed under the gnu general public license, version 2", 5),
    Notice("lgpl", "gnu lesser general public license", 3),
    Notice("mit-notice", "licensed under the mit license", 3),
    Notice("mit-grant", "permission is hereby granted, free of charge, to any person obtaining a copy", 7),
    Notice("cc-by-nc-4.0", "licensed under cc by-nc 4.0", 2),
    Notice("cc-by-sa-4.0", "licensed under cc by-sa 4.0", 2),
    Notice("cc-by-4.0", "licensed under cc by 4.0", 2),
    Notice("cc-by-long", "creative commons attribution", 2),
    Notice("bsd-notice", "redistribution and use in source and binary forms, with or without modification", 7),
    Notice("mpl-2.0", "mozilla public license, version 2.0", 3),
    Notice("reserved", "all rights reserved", 1),
)


def pieces(notice: Notice) -> list[tuple[int, str]]:
    """(offset, piece): errors + 1 pieces of about equal length that make up the notice."""
    count, length = notice.errors + 1, len(notice.text)
    cuts = [length * i // count for i in range(count + 1)]
    return [(a, notice.text[a:b]) for a, b in zip(cuts, cuts[1:])]


class FuzzySearch:
    """Finds every notice in a lower-cased text."""

    def __init__(self, notices: tuple[Notice, ...]):
        self.notices = notices
        self.patterns = [
            regex.compile(f"(?b)(?:{regex.escape(n.text)}){{e<={n.errors}}}") if n.errors else regex.compile(regex.escape(n.text))
            for n in notices
        ]
        seeds: dict[str, list[tuple[int, int]]] = {}
        for at, notice in enumerate(notices):
            for offset, piece in pieces(notice):
                seeds.setdefault(piece, []).append((at, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, places in seeds.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()

    def windows(self, text: str) -> list[tuple[int, int, int]]:
        """(notice, start, end): where a notice may lie; each window is a notice's length and twice its errors."""
        found = {}
        for last, (length, places) in self.automaton.iter(text):
            for at, offset in places:
                notice = self.notices[at]
                begin = last + 1 - length - offset
                lo = max(0, begin - notice.errors)
                found[(at, lo, min(len(text), begin + len(notice.text) + notice.errors))] = None
        return list(found)

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(notice, start, end, edits) sorted by start; of overlapping matches of a notice the one with fewest edits."""
        best = {}
        for at, lo, hi in self.windows(text):
            match = self.patterns[at].search(text, lo, hi)
            if match:
                best[(at, match.start(), match.end())] = sum(match.fuzzy_counts)
        kept: list[tuple[int, int, int, int]] = []
        for (at, start, end), edits in sorted(best.items(), key=lambda m: (m[0][0], m[0][1], m[0][2])):
            if kept and kept[-1][0] == at and start < kept[-1][2]:
                if edits < kept[-1][3]:
                    kept[-1] = (at, start, end, edits)
            else:
                kept.append((at, start, end, edits))
        return sorted(kept, key=lambda m: (m[1], m[0]))


def phrase_places(lowered: bytes) -> list[tuple[int, int]]:
    """(phrase, byte offset) of every place of an exact phrase: no phrase's end begins another, so none overlap."""
    if b"license" not in lowered and b"cc" not in lowered:
        return []
    return [(m.lastindex - 1, m.start()) for m in _PHRASE.finditer(lowered)]


def scan(docs: DataFrame, notices: tuple[Notice, ...] = NOTICES) -> DataFrame:
    """The columns of docs but the text, and what its license notices are.

    n_words; places: array of (label, word), every place of an exact phrase, words from 0; matches: array of
    (notice, start, end, edits) in code points of the text. A null or empty text has 0 words and empty arrays. One row
    for each row of docs, whole texts.
    """

    def make():
        search = FuzzySearch(notices)
        place = pa.struct([("label", pa.string()), ("word", pa.int64())])
        kind = pa.struct([("notice", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("edits", pa.int32())])

        def work(texts: list[str]) -> list[pa.Array]:
            n_words, places, matches = [], [], []
            for text in texts:
                # Only A to Z have other lower-case bytes here.
                lowered = text.encode("utf-8", "surrogatepass").lower()
                is_word = WORD_BYTE[np.frombuffer(lowered, np.uint8)]
                starts = np.flatnonzero(is_word & ~np.concatenate(([False], is_word[:-1])))
                n_words.append(len(starts))
                found = phrase_places(lowered)
                words = np.searchsorted(starts, [offset for _, offset in found])
                places.append([{"label": PHRASES[p][1], "word": int(w)} for (p, _), w in zip(found, words)])
                matches.append(
                    [
                        {"notice": notices[at].label, "start": s, "end": e, "edits": edits}
                        for at, s, e, edits in search.find(lowered.decode("utf-8", "surrogatepass"))
                    ]
                )
            return [
                pa.array(n_words, pa.int64()),
                pa.array(places, pa.list_(place)),
                pa.array(matches, pa.list_(kind)),
            ]

        return work

    place = T.StructType([T.StructField("label", T.StringType(), False), T.StructField("word", T.LongType(), False)])
    return map_texts(
        docs,
        make,
        [
            T.StructField("n_words", T.LongType(), False),
            T.StructField("places", T.ArrayType(place, False), False),
            T.StructField("matches", T.ArrayType(MATCH, False), False),
        ],
    )

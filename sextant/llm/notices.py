"""License scans: fuzzy search for short notices.

A text is read as its words (letters, digits and everything beyond ASCII, A-Z lower-cased), joined by single blanks. A notice of n characters is found
where a run of whole words is at most floor(n / PER_EDIT) edits away (a character or blank inserted, deleted or replaced). With k edits allowed,
a notice is split into k + 1 pieces, and by the pigeonhole principle one of them stands unchanged in every match: an Aho-Corasick automaton over the
pieces of all notices finds these seeds in one pass. A seed at place s, at offset o of its notice, allows matches that begin within k of
s - o; each word that begins there is tried by the regex library's bounded-error matching (best match, ending at a word's end), which verifies the
edits and gives the span. Matches of a notice that overlap are settled by fewest edits, then the leftmost, then the longest; exact ones all stay.

Phrases are notices without edits: their one piece is the phrase itself, and its matches are verified in the same way.

Scale: one pass over the texts in Arrow batches, without a shuffle; whole texts. Nothing grows with the corpus: the automaton holds the pieces
of NOTICES. Of a text, its words and spans are held. Verified windows are remembered (SEEN of them), so that a line that half of
all documents share costs a look-up.

Defined cases: null and empty texts have no words and no match; a repeated row is scanned again and gives the same; a word of any length
is a word; columns of the input pass through unless they have one of the result's names (`OUT`), which are replaced; an empty table gives no rows.
Spans are in code points of the text as given.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.llm.common import read_table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
OUT = ("n_words", "matches")
#: Characters of a notice for each edit; verified windows that a task remembers.
PER_EDIT, SEEN = 12, 1 << 16
MATCH = "array<struct<notice int, label string, exact boolean, similarity double, edits int, first_word long, end_word long, begin long, end long>>"


@dataclass(frozen=True)
class Notice:
    label: str
    words: str
    #: Phrases are matched without edits.
    phrase: bool = False

    @property
    def edits(self) -> int:
        return 0 if self.phrase else len(self.words) // PER_EDIT


# The phrases and labels of the contract.
PHRASES = (
    Notice("gpl", "gnu general public license", True),
    Notice("apache", "apache license", True),
    Notice("cc-by", "cc by", True),
    Notice("mit", "mit license", True),
)

# Short notices of common licenses, as they are put at the head of a file or page.
NOTICES = PHRASES + (
    Notice("agpl", "gnu affero general public license"),
    Notice("apache", "apache license"),
    Notice("apache", "licensed under the apache license version 2 0"),
    Notice("apache", "you may not use this file except in compliance with the license"),
    Notice("apache", "unless required by applicable law or agreed to in writing software distributed under the license"),
    Notice("artistic", "the artistic license 2 0"),
    Notice("boost", "distributed under the boost software license version 1 0"),
    Notice("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    Notice("bsd", "use of this source code is governed by a bsd style license"),
    Notice("bsd", "released under the bsd license"),
    Notice("cc-by", "creative commons attribution 4 0 international"),
    Notice("cc-by-nc", "creative commons attribution noncommercial"),
    Notice("cc-by-nc", "licensed under cc by nc"),
    Notice("cc-by-nd", "creative commons attribution noderivatives"),
    Notice("cc-by-sa", "creative commons attribution sharealike"),
    Notice("cc-by-sa", "licensed under cc by sa"),
    Notice("cc0", "cc0 1 0 universal public domain dedication"),
    Notice("epl", "eclipse public license"),
    Notice("gpl", "gnu general public license"),
    Notice("gpl", "licensed under the gnu general public license version"),
    Notice("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license"),
    Notice("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    Notice("lgpl", "gnu lesser general public license"),
    Notice("lgpl", "gnu library general public license"),
    Notice("mit", "mit licence"),
    Notice("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    Notice("mit", "released under the mit license"),
    Notice("mpl", "this source code form is subject to the terms of the mozilla public license"),
    Notice("mpl", "mozilla public license version 2 0"),
    Notice("proprietary", "all rights reserved unauthorized copying of this file is strictly prohibited"),
    Notice("unlicense", "this is free and unencumbered software released into the public domain"),
    Notice("wtfpl", "do what the fuck you want to public license"),
    Notice("zlib", "this software is provided as is without any express or implied warranty"),
)


def pieces(notice: Notice) -> list[tuple[int, str]]:
    """The notice in edits + 1 pieces of nearly equal length, each with its offset."""
    n, k = len(notice.words), notice.edits + 1
    cuts = [i * n // k for i in range(k + 1)]
    return [(a, notice.words[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Scanner:
    """Finds the notices in a text."""

    def __init__(self, notices: tuple[Notice, ...] = NOTICES) -> None:
        self.notices = notices
        self.seeds = ahocorasick.Automaton()
        at: dict[str, list[tuple[int, int]]] = {}
        for i, notice in enumerate(notices):
            for offset, piece in pieces(notice):
                at.setdefault(piece, []).append((i, offset))
        for piece, of in at.items():
            self.seeds.add_word(piece, (len(piece), of))
        self.seeds.make_automaton()
        self.patterns = [regex.compile(rf"(?b)(?:{regex.escape(x.words)}){{e<={x.edits}}}(?![^ ])" if x.edits else rf"{regex.escape(x.words)}(?![^ ])") for x in notices]
        self.verified = lru_cache(SEEN)(self._verified)

    def _verified(self, i: int, window: str) -> tuple[int, int] | None:
        """Length and edits of the best match of notice i that begins the window and ends with a word."""
        m = self.patterns[i].match(window)
        return (m.end(), sum(m.fuzzy_counts)) if m and m.end() else None

    def scan(self, text: str) -> tuple[int, list[tuple]]:
        """The number of words, and the matches in their order, as MATCH has them."""
        low = text.lower() if text.isascii() else text.translate(_LOWER)
        words = WORD.findall(low)
        whole = " ".join(words)
        tried: set[tuple[int, int]] = set()
        found: dict[int, list[tuple[int, int, int]]] = {}
        for last, (size, of) in self.seeds.iter(whole):
            for i, offset in of:
                k, n = self.notices[i].edits, len(self.notices[i].words)
                begin = last - size + 1 - offset
                for s in range(max(0, begin - k), min(len(whole), begin + k + 1)):
                    if (s == 0 or whole[s - 1] == " ") and whole[s] != " " and (i, s) not in tried:
                        tried.add((i, s))
                        # One character more than a match can have: whether a word ends there is seen.
                        if got := self.verified(i, whole[s : s + n + k + 1]):
                            found.setdefault(i, []).append((got[1], s, s + got[0]))
        if not found:
            return len(words), []
        spans = [m.span() for m in WORD.finditer(low)]
        starts, at = [], 0
        for a, b in spans:
            starts.append(at)
            at += b - a + 1
        word = {s: j for j, s in enumerate(starts)}
        out = []
        for i, hits in found.items():
            notice, taken = self.notices[i], []
            for edits, s, e in sorted(hits, key=lambda x: (x[0], x[1], -x[2])):
                if edits and any(s < y and x < e for x, y in taken):
                    continue
                taken.append((s, e))
                a, b = word[s], word.get(e + 1, len(spans))
                out.append((i, notice.label, notice.phrase, 1 - edits / len(notice.words), edits, a, b, spans[a][0], spans[b - 1][1]))
        return len(spans), sorted(out, key=lambda x: (x[5], x[0], x[6]))


def scan(docs: DataFrame, notices: tuple[Notice, ...] = NOTICES) -> DataFrame:
    """Adds n_words and matches: each with its notice's number and label, whether it is a phrase, 1 - edits / length, its edits, words
    [first_word, end_word) and code points [begin, end) of the text."""
    docs = docs.drop(*OUT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(notices)
        keys = ("notice", "label", "exact", "similarity", "edits", "first_word", "end_word", "begin", "end")
        kind = pa.list_(pa.struct([("notice", pa.int32()), ("label", pa.string()), ("exact", pa.bool_()), ("similarity", pa.float64()), ("edits", pa.int32()), *[(x, pa.int64()) for x in keys[5:]]]))
        for batch in batches:
            got = [scanner.scan(t or "") for t in batch["text"].to_pylist()]
            rows = pa.array([[dict(zip(keys, m, strict=True)) for m in ms] for _, ms in got], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([n for n, _ in got], pa.int64()), rows], [*batch.schema.names, *OUT])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{schema}n_words long, matches {MATCH}")


def labels_of(matches: str = "matches"):
    return F.array_join(F.array_sort(F.array_distinct(F.transform(matches, lambda m: m["label"]))), ",")


def op11_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """score: the greatest similarity of a match, 0 without one."""
    rows = scan(read_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    base = F.filter("matches", lambda m: m["exact"])
    words = F.transform(base, lambda m: m["first_word"])
    score = F.coalesce(F.array_max(F.transform("matches", lambda m: m["similarity"])), F.lit(0.0))
    return rows.withColumn("_base", base).select(
        "doc_id", "n_words", F.size("_base").cast("long").alias("n_base"), F.array_min(words).alias("first_word"), F.array_max(words).alias("last_word"),
        labels_of("_base").alias("base_labels"), labels_of().alias("labels"), score.alias("score"), F.size("matches").cast("long").alias("n_matches"),
    )

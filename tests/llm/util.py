"""Rows that every operator must bear, and plain helpers for brute-force versions."""

import re

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

BASE = "the quick brown fox jumps over the lazy dog while seven wizards brew potions near an old stone bridge at dawn"
LONG = " ".join(f"word{i % 97} and{i % 13} thing{i}" for i in range(9000))
ODD = [
    (1, "", "en", "a", 0),
    (2, None, None, None, None),
    (3, " \t\n ", "en", "a", 4),
    (4, BASE, "en", "b", len(BASE)),
    (5, BASE, "en", "b", len(BASE)),
    (5, BASE, "en", "b", len(BASE)),
    (None, BASE + " extra", "de", None, 5),
    (6, "Ünïcödé ⚠ text 😀 with ascii", "fr", "c", 20),
    (7, LONG, "en", "a", len(LONG)),
    (8, "one", "en", "a", 3),
    (9, "two words", "en", "zz", 9),
    (10, BASE.upper(), "en", "b", len(BASE)),
    (11, "x" * 3000, "en", "a", 3000),
    (12, "ab " * 900, "en", "a", 2700),
    (13, LONG[5000:40000], "en", "c", 35000),
]


def odd(spark, rows=ODD):
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def wide(df):
    """With further columns whose names clash with what operators use inside."""
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(1) for c in ("size", "node", "score", "region", "_b", "th", "shard", "spans", "anchors", "left", "label")})


def tokens(t):
    return WORDS.findall((t or "").translate(LOWER))

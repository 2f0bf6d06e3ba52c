"""Source divergence audit: how far the vocabularies of a language's sources lie apart, by a byte-level tokenizer.

Texts of a chunk are one UTF-8 buffer. A lookup table over its bytes marks those of terms (ASCII letters and everything beyond ASCII), and so
the boundaries; a second one lower-cases A-Z. xxhash groups the slices (of those that are one and the same number of up to 8 bytes, one is hashed), and
every hashed slice is then compared byte by byte with the first one of its group; those that differ are grouped anew, so that equal hashes never decide. Counts leave a task by term, not by hash, and are summed by
the term's bytes.

The terms in at least `least` documents of a language are its vocabulary. With count c of N in a group, and V terms, a term's share is
1 + floor(SCALE * (c + PRIOR) / (N + PRIOR * V)), in whole numbers throughout. Pairs of sources are compared over blocks of BLOCK terms: a
block is a CSR matrix (sources by terms, counts), a source's column vector is laid out once, and the rows' differences are summed with reduceat; what
a source lacks has its least share, and is settled by counting.

Scale: texts are read once and combined by term in the tasks before they are shuffled; after the first sum only rows (lang, source, term) move, so
that a source with a third of all rows is as many rows as it has terms. A block is a task's work (BLOCK terms and the sources of
one language); its result, one row a pair of sources, is summed by Spark. Pairs of sources are the result itself. No step gathers a language in one task.

Defined cases: null text, lang and source are ''; a repeated row is a document each time; a group without terms has the least share
everywhere; a language without vocabulary has the value 0 for its pairs; a language with one source has no pairs; an empty table gives no rows.
Columns other than text, lang and source aren't read. The sum of counts may reach 9.2e15 in a language (SCALE is applied in steps of 1000).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sextant.llm.common import cut, groups, read_table, text_bytes

#: Bytes of a term, and each byte lower-cased where it is A-Z.
IN_TERM = np.ones(256, bool)
IN_TERM[:65] = IN_TERM[91:97] = IN_TERM[123:128] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_UPTO = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)

SCALE, PRIOR = 1_000_000_000, 5
#: Bytes of text that are tokenised at a time (a longer text alone), terms of a block, bytes that are compared at a time.
CHUNK, BLOCK, COMPARE = 8 << 20, 4096, 1 << 20


def slices(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the terms in the texts data[offsets[i]:offsets[i + 1]], and the text of each."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = IN_TERM[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def _differs(low: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether low[a:a + size] and low[b:b + size] differ, for each of many slices, about COMPARE bytes at a time."""
    out = np.zeros(len(a), bool)
    ends = np.cumsum(size)
    i = 0
    while i < len(a):
        done = int(ends[i - 1]) if i else 0
        j = max(i + 1, int(np.searchsorted(ends, done + COMPARE, "right")))
        if j == i + 1:
            out[i] = not np.array_equal(low[a[i] : a[i] + size[i]], low[b[i] : b[i] + size[i]])
        else:
            n, first = size[i:j], ends[i:j] - size[i:j] - done
            at = np.arange(int(n.sum())) - np.repeat(first, n)
            out[i:j] = np.logical_or.reduceat(low[np.repeat(a[i:j], n) + at] != low[np.repeat(b[i:j], n) + at], first)
        i = j
    return out


def packed(low: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Slices of up to 8 bytes as one number each. Terms have no zero bytes, so that equal numbers are equal slices."""
    whole = np.concatenate([low, np.zeros(8, np.uint8)])
    return np.ndarray(len(low) + 1, "<u8", whole, strides=(1,))[starts] & _UPTO[size]


def grouped(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashed=xxhash.xxh3_64_intdigest) -> tuple[np.ndarray, np.ndarray]:
    """Slices grouped by their hashes, each compared with the first of its group; those that differ are grouped anew."""
    whole = low.tobytes()
    h = np.fromiter(map(hashed, map(whole.__getitem__, map(slice, starts.tolist(), ends.tolist()))), np.uint64, len(starts))
    size, ids, shown, todo, base = ends - starts, np.empty(len(starts), np.int64), [], np.arange(len(starts)), 0
    while len(todo):
        _, first, which = np.unique(h[todo], return_index=True, return_inverse=True)
        one = todo[first]
        other = one[which]
        same = size[todo] == size[other]
        k = np.flatnonzero(same)
        same[k] = ~_differs(low, starts[todo[k]], starts[other[k]], size[todo[k]])
        ids[todo[same]] = base + which[same]
        shown.append(one)
        base += len(one)
        todo = todo[~same]
    return ids, np.concatenate(shown) if shown else np.zeros(0, np.int64)


def same_slices(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashed=xxhash.xxh3_64_intdigest) -> tuple[np.ndarray, np.ndarray]:
    """A number for each slice, equal for equal bytes, and one slice of each number. Of short slices that are the same number, one is hashed."""
    size = ends - starts
    short, long = np.flatnonzero(size <= 8), np.flatnonzero(size > 8)
    _, first, which = np.unique(packed(low, starts[short], size[short]), return_index=True, return_inverse=True)
    chosen = np.concatenate([short[first], long])
    found, shown = grouped(low, starts[chosen], ends[chosen], hashed)
    ids = np.empty(len(starts), np.int64)
    ids[short], ids[long] = found[: len(first)][which], found[len(first) :]
    return ids, chosen[shown]


def cut_out(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.BinaryArray:
    """The slices as an Arrow column, without a Python object for each."""
    size = ends - starts
    offsets = np.zeros(len(size) + 1, np.int32)
    np.cumsum(size, out=offsets[1:])
    data = low[np.arange(int(offsets[-1])) + np.repeat(starts - offsets[:-1], size)]
    return pa.BinaryArray.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _counted(low: np.ndarray, offsets: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Of the texts of a chunk: group, term, occurrences and documents, a row for each term of a group."""
    starts, ends, text = slices(low, offsets)
    ids, shown = same_slices(low, starts, ends)
    n = max(1, len(shown))
    # Each term of a text once, with its occurrences there; then by group.
    pairs, each = np.unique(text * n + ids, return_counts=True)
    keys, which, docs = np.unique(group[pairs // n] * n + pairs % n, return_inverse=True, return_counts=True)
    count = np.bincount(which, each, len(keys)).astype(np.int64)
    return keys // n, cut_out(low, starts[shown], ends[shown]).take(pa.array(keys % n)), count, docs


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of every term in a group, and rows of documents with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = {}
            group = np.array([names.setdefault(x, len(names)) for x in zip(batch["lang"].to_pylist(), batch["source"].to_pylist(), strict=True)], np.int64)
            langs, sources = (pa.array(x, pa.string()) for x in zip(*names, strict=True)) if names else (pa.array([], pa.string()),) * 2
            data, offsets = text_bytes(batch["text"])
            for a, b in groups(offsets, CHUNK):
                at = offsets[a : b + 1]
                of, terms, n, k = _counted(LOWER[data[at[0] : at[-1]]], at - at[0], group[a:b])
                of = pa.array(of)
                yield pa.RecordBatch.from_arrays([langs.take(of), sources.take(of), terms, pa.array(n), pa.array(k)], ["lang", "source", "term", "n", "docs"])

    rows = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), F.col("text").cast("binary").alias("text"))
    found = rows.mapInArrow(run, "lang string, source string, term binary, n long, docs long").withColumn("term", F.col("term").cast("string"))
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, size: Column) -> Column:
    """1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * size)) by long division; size is over 0."""
    most = total + PRIOR * size
    left, out = count + PRIOR, F.lit(0).cast("long")
    for _ in range(3):
        left = left * 1000
        out, left = out * 1000 + F.call_function("div", left, most), left % most
    return out + 1


def shares(count: np.ndarray, most: np.ndarray) -> np.ndarray:
    """The same for arrays; most: total + PRIOR * size."""
    left, out = count.astype(np.int64) + PRIOR, np.int64(0)
    for _ in range(3):
        left = left * 1000
        out, left = out * 1000 + left // most, left % most
    return out + 1


def block_distances(row: np.ndarray, term: np.ndarray, count: np.ndarray, terms: int, most: np.ndarray) -> np.ndarray:
    """Sums of |p - q| over a block's terms for all pairs of sources. Entries (row, term, count) over 0; most: each source's divisor."""
    n = len(most)
    order = np.lexsort((term, row))
    row, term, p = row[order], term[order], shares(count[order], most[row[order]])
    first = np.searchsorted(row, np.arange(n + 1))  # the rows of the CSR matrix
    full = np.flatnonzero(np.diff(first))
    least = shares(np.zeros(n, np.int64), most)
    out = np.zeros((n, n), np.int64)
    for j in range(n):
        mine = slice(first[j], first[j + 1])
        q = np.full(terms, least[j])
        q[term[mine]] = p[mine]
        # Every source as if it had no term of the block, then what its own terms change.
        out[:, j] = (terms - (mine.stop - mine.start)) * np.abs(least - least[j]) + np.abs(least[:, None] - p[mine][None, :]).sum(1)
        if len(full):
            out[full, j] += np.add.reduceat(np.abs(p - q[term]) - np.abs(least[row] - q[term]), first[full])
    return out


def _compare(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    """Of one block: (lang, a, b, value) for the numbers a < b of its sources."""
    most = right.sort_by("row")["most"].to_numpy()
    terms = left["term"].combine_chunks().dictionary_encode()
    d = block_distances(left["k"].to_numpy().astype(np.int64), terms.indices.to_numpy().astype(np.int64), left["n"].to_numpy(), len(terms.dictionary), most)
    a, b = np.triu_indices(len(most), 1)
    return pa.table({"lang": pa.array([key[0].as_py()] * len(a), pa.string()), "a": pa.array(a, pa.int32()), "b": pa.array(b, pa.int32()), "value": pa.array(d[a, b], pa.int64())})


def audit(docs: DataFrame, least: int = 30, top: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank). Part pair: every other source of the language, by the sum of the differences over its
    vocabulary; part term: the `top` terms that a source has more of than its language."""
    cluster = Window.partitionBy("lang", "term")
    kept = term_counts(docs).withColumn("_docs", F.sum("docs").over(cluster)).withColumn("all", F.sum("n").over(cluster))
    kept = cut(kept.filter(F.col("_docs") >= least).select("lang", "source", "term", "n", "all"))
    langs = kept.groupBy("lang", "term").agg(F.max("all").alias("all")).groupBy("lang").agg(F.count("*").alias("size"), F.sum("all").alias("lang_total"))
    sources = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct()
    sources = sources.join(kept.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "size", "lang_total"])
    sources = cut(sources.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1))

    known = kept.join(sources, ["lang", "source"])
    blocks = F.ceil(F.col("size") / BLOCK)
    left = known.select("lang", F.pmod(F.xxhash64("term"), blocks).cast("int").alias("block"), "k", "term", "n")
    right = sources.filter("size > 0").select(F.col("lang").alias("of"), F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int"))).alias("of_block"), F.col("k").alias("row"), (F.col("total") + PRIOR * F.col("size")).alias("most"))
    # A block that no term fell into has nothing to add.
    sums = left.groupBy("lang", "block").cogroup(right.groupBy("of", "of_block")).applyInArrow(_compare, "lang string, a int, b int, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    sums = cut(sums)
    sums = sums.union(sums.select("lang", "b", "a", "value"))
    pairs = sources.select("lang", "source", F.col("k").alias("a")).join(sources.select("lang", F.col("source").alias("item"), F.col("k").alias("b")), "lang").filter("a <> b")
    pairs = pairs.join(sums, ["lang", "a", "b"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))

    p, q = share(F.col("n"), F.col("total"), F.col("size")), share(F.col("all"), F.col("lang_total"), F.col("size"))
    terms = known.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (p - q).alias("value")).filter("value > 0")
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(ranked).cast("int")
    return pairs.withColumn("rank", rank).unionByName(terms.withColumn("rank", rank).filter(F.col("rank") <= top))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(read_table(spark, sf_dir, "documents"))


#: The same in SQL: shares in 128-bit numbers.
SQL = r"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
 w AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
 c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM w GROUP BY ALL),
 l AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL HAVING sum(docs) >= 30),
 v AS (SELECT lang, count(*) AS size, sum(n) AS total FROM l GROUP BY ALL),
 g AS (SELECT DISTINCT lang, source FROM d),
 k AS (SELECT g.lang, g.source, l.term, l.n AS all_n, coalesce(c.n, 0) AS n, v.size, v.total FROM g JOIN l ON l.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = l.term),
 p AS (SELECT lang, source, term, n, 1 + 1000000000::HUGEINT * (n + 5) // (sum(n) OVER (PARTITION BY lang, source) + 5 * size) AS p, 1 + 1000000000::HUGEINT * (all_n + 5) // (total + 5 * size) AS q FROM k),
 s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL),
 o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
 r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM o)
 SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM r WHERE part = 'pair' OR rank <= 50"""

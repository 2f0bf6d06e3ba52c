"""Suffix-array dedup by run-length index: every byte under a string of `length` bytes that starts anywhere else is removed, exactly.

1. Anchors. In each string of `length` bytes the rightmost least hash of its substrings of half that length is an anchor, so that equal
   strings have equal anchors at equal places. An anchor's context is all strings of `length` that hold it (at most twice
   the length). Anchors that occur once are dropped; contexts that occur twice are removed as they are, by hash alone.
2. Run-length index. Of anchors with several different contexts, one copy of each context is fetched. Contexts are dealt
   to blocks by anchor, those of one text merged where they overlap (so that no place stands twice), and each block's suffixes
   sorted by prefix doubling. Of its Burrows-Wheeler transform only the ends of its runs are sampled, with the common
   prefix of the suffixes on either side; matching statistics are streamed from these samples (between them they fall by one
   from place to place), and where they reach `length`, the match is marked.
3. Anchors with more than HOT different contexts don't go to one block: their contexts' strings are cut into ranges of starts,
   of which only those whose common core occurs twice go on, and these are counted string by string. Exact as well, and
   pre-aggregated at every step.

Scale: about one anchor in `length` / 4 bytes is shuffled (a narrow row); the texts are read three times. Blocks hold
BLOCK bytes and the contexts of an anchor at most. Copies of a text are told from the start by its hash, and are no work later.

Strings are compared by 64-bit hashes in steps 1 and 3 and byte by byte in step 2; texts are told apart by a 64-bit hash.

Defined cases: null texts are empty; texts shorter than `length` keep everything; repeated rows are copies of each other and
lose all their bytes if long enough; a null doc_id is kept as it is; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.llm.common import _TABLE, U64, cut, groups, mix, powers, read_table, text_bytes

#: An anchor's contexts go to one block up to so many (with length 400, under two megabytes); bytes of a block; ranges of starts.
HOT, BLOCK, RANGES = 3000, 1 << 19, 8
#: Bytes that the first sort of suffixes looks at.
STEM = 5
_HIGH, _LOW = U64(0xFFFFFFFF00000000), U64(0xFFFFFFFF)


def window_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the strings data[begin:end]."""
    p, q = powers(len(data) + 1)
    c = np.zeros(len(data) + 1, U64)
    np.cumsum(_TABLE[data] * p[: len(data)], out=c[1:])
    return mix((c[end] - c[begin]) * q[begin] + (end - begin).astype(U64))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each w values in a row."""
    n = len(x) - w + 1
    y = np.full(-(-len(x) // w) * w, ~U64(0))
    y[: len(x)] = x
    y = y.reshape(-1, w)
    left = np.minimum.accumulate(y, axis=1).ravel()
    right = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[w - 1 : w - 1 + n])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Of the texts in data: each anchor's text, place in data, hash, and the hash, begin and end of its context."""
    k = length // 2
    w = length - k + 1
    n = len(data)
    size = np.diff(offsets)
    long = size >= length
    if not long.any():
        z = np.zeros(0, np.int64)
        return z, z, z.astype(U64), z.astype(U64), z, z
    p, q = powers(n + 1)
    c = np.zeros(n + 1, U64)
    np.cumsum(_TABLE[data] * p[:n], out=c[1:])
    m = n - k + 1
    g = mix((c[k:] - c[:m]) * q[:m])
    key = (g & _HIGH) | (_LOW - np.arange(m, dtype=U64))
    low = sliding_min(key, w)  # by start of a string, those across texts too
    start = np.repeat(offsets[:-1][long], size[long] - length + 1)
    first = np.r_[0, np.cumsum(size[long] - length + 1)]
    start += np.arange(len(start)) - np.repeat(first[:-1], np.diff(first))
    at = (_LOW - (low[start] & _LOW)).astype(np.int64)
    at = at[np.r_[True, at[1:] != at[:-1]]]
    doc = np.searchsorted(offsets, at, "right") - 1
    begin, end = np.maximum(offsets[doc], at - (length - k)), np.minimum(offsets[doc + 1], at + length)
    whole = mix((c[end] - c[begin]) * q[begin] + mix((at - begin).astype(U64) * U64(100003) + (end - at).astype(U64)))
    return doc, at, g[at], whole, begin, end


def anchor_rows(docs: DataFrame, length: int) -> DataFrame:
    """docs (th, text) -> a row for each anchor of each distinct text of a batch; size: of its context, lead: its place in it, n: how often the batch has it."""
    names, kinds = ["g", "c", "th", "begin", "end", "size", "lead", "n"], [*[pa.int64()] * 3, *[pa.int32()] * 5]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            th = b.column(0).to_numpy()
            _, first, n = np.unique(th, return_index=True, return_counts=True)
            order = np.argsort(first)
            first, n = first[order], n[order]
            data, offsets = text_bytes(b.column(1).take(pa.array(first)))
            for x, y in groups(offsets):
                base = offsets[x:y] - offsets[x]
                doc, at, g, c, begin, end = anchors(data[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x], length)
                if not len(g):
                    continue
                # A stretch that repeats itself has one context again and again: those that touch are one row.
                sort = np.lexsort((begin, c, g))
                doc, at, g, c, begin, end = doc[sort], at[sort], g[sort], c[sort], begin[sort], end[sort]
                new = np.r_[True, (g[1:] != g[:-1]) | (c[1:] != c[:-1]) | (doc[1:] != doc[:-1]) | (begin[1:] > end[:-1])]
                head = np.flatnonzero(new)
                many = np.diff(np.r_[head, len(g)])
                size, lead = (end - begin)[head], (at - begin)[head]
                last = end[np.r_[head[1:], len(g)] - 1]
                doc, g, c, begin = doc[head], g[head], c[head], begin[head]
                d = doc + x
                columns = [g.view(np.int64), c.view(np.int64), th[first[d]], begin - base[doc], last - base[doc], size, lead, n[d] * many]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, kinds, strict=True)], names)

    return docs.select("th", "text").mapInArrow(run, "g long, c long, th long, begin int, end int, size int, lead int, n int")


class RunLengthIndex:
    """A block of byte strings: the run ends of the Burrows-Wheeler transform of all their suffixes, with common prefixes.

    least: samples whose common prefix is shorter are left out, as of no use to the caller.
    """

    def __init__(self, segments: list[bytes], least: int = 1):
        size = np.array([len(s) for s in segments], np.int64)
        self.first = np.r_[0, np.cumsum(size)]
        data = np.frombuffer(b"".join(segments), np.uint8)
        n = len(data)
        self.end = np.repeat(self.first[1:], size).astype(np.int32)
        here = np.arange(n, dtype=np.int32)
        left = (self.end - here).astype(np.int32)
        padded = np.zeros(n + STEM, np.int64)
        padded[:n] = data
        key = np.zeros(n, np.int64)
        for j in range(STEM):
            key = key * 257 + np.where(left > j, padded[j : j + n] + 1, 0)
        order, rank = self._sorted(key, 257**STEM)
        self.levels: list[tuple[int, np.ndarray]] = [(STEM, rank)]
        h, most = STEM, int(size.max(initial=0))
        while h < most and rank.max(initial=0) < n:
            nxt = np.zeros(n, np.int64)
            nxt[: n - h] = np.where(left[: n - h] > h, rank[h:], 0)
            order, rank = self._sorted(rank.astype(np.int64) * (n + 1) + nxt, (n + 1) ** 2)
            h *= 2
            self.levels.append((h, rank))
        # Suffixes that are equal to their ends stand in the order of their places, so those before them do too.
        before = np.where(here > np.repeat(self.first[:-1], size), np.r_[0, data[:-1]], -1 - here) if n else here
        bwt = before[order]
        heads = np.flatnonzero(bwt[1:] != bwt[:-1]) + 1
        self.runs = len(heads) + 1
        a, b = order[heads - 1], order[heads]
        for h, rank in self.levels:  # pairs that share too little are told by one look
            if h <= least:
                same = rank[a] == rank[b]
                a, b = a[same], b[same]
        lcp = self._common(data, a, b)
        a, b, lcp = a[lcp >= least], b[lcp >= least], lcp[lcp >= least]
        #: Sampled run ends: places in the text with the match that begins there.
        self.at, self.match = np.r_[a, b], np.r_[lcp, lcp]

    @staticmethod
    def _sorted(key: np.ndarray, bound: int) -> tuple[np.ndarray, np.ndarray]:
        """Places in the order of their keys (equal ones by place), and each place's rank from 1 (equal ones alike)."""
        n = len(key)
        bits = max(1, n.bit_length())
        if bound << bits < 1 << 63:  # key and place in one number: a plain sort
            sorted_ = key << bits
            sorted_ |= np.arange(n)
            sorted_.sort()
            order = (sorted_ & ((1 << bits) - 1)).astype(np.int32)
            sorted_ >>= bits
        else:
            order = np.argsort(key, kind="stable")
            sorted_ = key[order]
        rank = np.empty(n, np.int32)
        rank[order] = np.cumsum(np.r_[True, sorted_[1:] != sorted_[:-1]][:n])
        return order, rank

    def _common(self, data: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefixes of pairs of suffixes, within their segments."""
        most = np.minimum(self.end[a] - a, self.end[b] - b)
        got = np.zeros(len(a), np.int64)
        top = len(data) - 1
        for h, rank in reversed(self.levels):
            same = (got < most) & (rank[np.minimum(a + got, top)] == rank[np.minimum(b + got, top)])
            got = np.minimum(got + h * same, most)
        for _ in range(STEM):
            same = (got < most) & (data[np.minimum(a + got, top)] == data[np.minimum(b + got, top)])
            if not same.any():
                break
            got += same
        return got

    def matching_statistics(self) -> np.ndarray:
        """At each place, the longest string that begins there and also elsewhere in the block: streamed from the samples."""
        reach = np.zeros(self.first[-1], np.int64)
        np.maximum.at(reach, self.at, self.at + self.match)
        place = np.arange(len(reach))
        return np.maximum(np.minimum(np.maximum.accumulate(reach), self.end) - place, 0)

    def marks(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Segment, begin and end (in it) of the maximal stretches under matches of at least `length`."""
        ms = self.matching_statistics()
        at = np.flatnonzero(ms >= length)
        cover = np.zeros(len(ms) + 1, np.int64)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + ms[at], -1)
        on = np.cumsum(cover)[:-1] > 0
        edge = np.zeros(len(ms) + 1, bool)
        edge[self.first] = True
        begin = np.flatnonzero(on & (~np.r_[False, on[:-1]] | edge[:-1]))
        last = np.flatnonzero(on & (~np.r_[on[1:], False] | edge[1:])) + 1
        seg = np.searchsorted(self.first, begin, "right") - 1
        return seg, begin - self.first[seg], last - self.first[seg]


def block_marks(length: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["th", "begin", "end"])
        segments, th, begin = [], [], []
        for t, b, x in zip(rows["th"], rows["begin"], rows["bytes"], strict=True):
            if th and th[-1] == t and b <= begin[-1] + len(segments[-1]):
                segments[-1] += x[max(0, begin[-1] + len(segments[-1]) - b) :]
            else:
                segments.append(bytes(x))
                th.append(t)
                begin.append(b)
        seg, a, z = RunLengthIndex(segments, length).marks(length)
        th, begin = np.array(th, np.int64), np.array(begin, np.int64)
        return pd.DataFrame({"th": th[seg], "begin": begin[seg] + a, "end": begin[seg] + z})

    return run


def fetch(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (doc_id, th, g, c, begin, end, lead), one document for each text: adds the bytes of the contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                text = (b.column(1)[i].as_py() or "").encode("utf-8")
                some = b.column(2)[i].as_py()
                for a in range(0, len(some), 20_000):
                    part = some[a : a + 20_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([b.column(0)[i].as_py()] * len(part), pa.int64()), *(pa.array([x[k] for x in part], pa.int64()) for k in ("g", "c", "begin", "end", "lead")), pa.array([text[x["begin"] : x["end"]] for x in part], pa.binary())],
                        ["th", "g", "c", "begin", "end", "lead", "bytes"],
                    )

    by = wanted.groupBy("doc_id", "th").agg(F.collect_list(F.struct("g", "c", "begin", "end", "lead")).alias("some"))  # a text's own anchors
    by = by.withColumnsRenamed({"doc_id": "_d", "th": "_t"})
    rows = docs.join(by, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_t"))).select("th", "text", "some")
    return rows.mapInArrow(run, "th long, g long, c long, begin long, end long, lead long, bytes binary")


def hot_marks(contexts: DataFrame, length: int) -> DataFrame:
    """Contexts (th, begin, end, lead, bytes) of anchors that have many: strings counted by hash, ranges with a lone core left out.

    Ranges are counted from the anchor, so that equal strings lie in equal ranges whatever a text's borders cut off. A range's
    core, what all its strings share, lies in each context that has one of them.
    """
    reach = length - length // 2
    step = -(-(reach + 1) // RANGES)

    def hashes(whole: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = ["th", "begin", "end", "lead", "r", "at", "h"]
            for b in batches:
                for first in range(0, b.num_rows, 200):  # a few contexts at a time: each makes `length` / 2 rows at most
                    part = b.slice(first, 200)
                    out: list[list] = [[] for _ in names]
                    for th, begin, end, lead, data, picks in zip(*(part.column(c).to_pylist() for c in range(4)), part.column(4), part.column(5).to_pylist(), strict=True):
                        x = np.frombuffer(data.as_py(), np.uint8)
                        starts = np.arange(len(x) - length + 1)
                        ranges = (starts - lead + reach) // step
                        if whole:  # the strings of the ranges that were picked
                            at = starts[np.isin(ranges, picks)]
                            h, r = window_hashes(x, at, at + length), np.zeros(len(at), np.int64)
                        else:
                            r = np.unique(ranges)
                            at = np.minimum((r + 1) * step - 1, reach) - reach + lead
                            h = window_hashes(x, at, r * step - reach + lead + length)
                        for column, v in zip(out, (np.full(len(h), th), np.full(len(h), begin), np.full(len(h), end), np.full(len(h), lead), r, begin + at, h.view(np.int64)), strict=True):
                            column.append(v)
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in out], names)

        return run

    schema = "th long, begin long, end long, lead long, r long, at long, h long"
    contexts = contexts.select("th", "begin", "end", "lead", "bytes").dropDuplicates(["th", "begin", "end", "lead"])
    cores = contexts.withColumn("picks", F.array().cast("array<long>")).mapInArrow(hashes(False), schema)

    def twice(rows: DataFrame) -> DataFrame:
        # A place that stands in two contexts of a text counts once.
        place = F.struct("th", "at")
        n = rows.groupBy("h").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).filter("lo <> hi")
        return rows.join(n.select(F.col("h").alias("_h")), F.col("h") == F.col("_h"), "left_semi")

    picked = twice(cores).groupBy("th", "begin", "end", "lead").agg(F.collect_set("r").alias("picks"))
    again = contexts.join(picked, ["th", "begin", "end", "lead"]).select("th", "begin", "end", "lead", "bytes", "picks")
    strings = twice(again.mapInArrow(hashes(True), schema))
    # A context's strings, a bounded number, as maximal stretches.
    by = strings.groupBy("th", "begin", "end", "lead").agg(F.array_sort(F.collect_set("at")).alias("ats"))
    start = F.array().cast("array<struct<b:bigint,e:bigint>>")

    def add(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        one = F.array(F.struct(x.alias("b"), (x + length).alias("e")))
        grown = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["b"].alias("b"), (x + length).alias("e"))))
        return F.when((F.size(acc) > 0) & (x <= last["e"]), grown).otherwise(F.concat(acc, one))

    return by.select("th", F.explode(F.aggregate("ats", start, add)).alias("s")).select("th", F.col("s.b").alias("begin"), F.col("s.e").alias("end"))


def repeated_spans(docs: DataFrame, length: int) -> DataFrame:
    """docs (doc_id, th, text) -> (th, spans): for each text with repeats, stretches (begin, end), overlapping or not, in any order."""
    texts = cut(docs.groupBy("th").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.max(F.octet_length("text")).cast("long").alias("size")))
    rows = anchor_rows(docs, length)
    # Anchors that occur once are dropped. Both sides aggregate before they are shuffled; a hot anchor's rows can be split.
    often = rows.groupBy("g").agg(F.sum("n").alias("total"), F.min("c").alias("lo"), F.max("c").alias("hi")).filter("total > 1")
    often = often.select(F.col("g").alias("_g"), (F.col("lo") != F.col("hi")).alias("mixed"))
    rows = cut(rows.join(often, F.col("g") == F.col("_g")).drop("_g"))
    kinds = rows.groupBy("g", "c", "mixed").agg(F.sum("n").alias("same"), F.min(F.struct("th", "begin", "size", "lead")).alias("one"))
    kinds = cut(kinds)
    done = kinds.filter("same > 1").select(F.col("g").alias("_g"), F.col("c").alias("_c"))
    covered = rows.join(done, (F.col("g") == F.col("_g")) & (F.col("c") == F.col("_c")), "left_semi").select("th", F.col("begin").cast("long"), F.col("end").cast("long"))
    wanted = kinds.filter("mixed").select("g", "c", "one.th", F.col("one.begin").cast("long").alias("begin"), (F.col("one.begin") + F.col("one.size")).cast("long").alias("end"), F.col("one.lead").cast("long").alias("lead"))
    many = wanted.groupBy("g").agg(F.count("*").alias("m")).withColumnRenamed("g", "_g")
    contexts = cut(fetch(docs, wanted.join(texts.select("th", "doc_id"), "th")).join(many, F.col("g") == F.col("_g")).drop("_g"))
    total = contexts.filter(F.col("m") <= HOT).agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK))
    cold = contexts.filter(F.col("m") <= HOT).withColumn("block", F.pmod("g", F.lit(blocks)))
    marks = cold.select("block", "th", "begin", "end", "bytes").groupBy("block").applyInPandas(block_marks(length), "th long, begin long, end long")
    hot = contexts.filter(F.col("m") > HOT)
    if hot.limit(1).count():
        marks = marks.union(hot_marks(hot, length))
    marks = marks.union(covered)
    # Copies of a text are removed whole; their own marks aren't needed.
    copied = texts.filter((F.col("copies") > 1) & (F.col("size") >= length))
    marks = marks.join(copied.select("th"), "th", "left_anti").union(copied.select("th", F.lit(0).cast("long"), "size"))
    return marks.groupBy("th").agg(F.collect_set(F.struct("begin", "end")).alias("spans"))


def merged(spans: list) -> list[tuple[int, int]]:
    """Stretches as maximal ones, ascending."""
    out: list[list[int]] = []
    for a, b in sorted((x["begin"], x["end"]) for x in spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, length: int = 400) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, n_bytes, spans, kept): removed stretches of the text's UTF-8 bytes, and the bytes that stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 1000):
                part = b.slice(a, 1000)
                spans, kept, size = [], [], []
                for text, found in zip(part.column(1), part.column(2), strict=True):
                    x = (text.as_py() or "").encode("utf-8")
                    s = merged(found.as_py() or [])
                    spans.append([{"begin": i, "end": j} for i, j in s])
                    kept.append(b"".join(x[i:j] for i, j in zip([0, *(j for _, j in s)], [*(i for i, _ in s), len(x)], strict=True)))
                    size.append(len(x))
                kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    spans = cut(repeated_spans(docs, length)).withColumnRenamed("th", "_th")
    rows = docs.join(spans, F.col("th") == F.col("_th"), "left").select("doc_id", "text", "spans")
    return rows.mapInArrow(run, "doc_id long, n_bytes long, spans array<struct<begin:long,end:long>>, kept binary")


def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(read_table(spark, sf_dir, "documents"), 400)
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))

"""N-gram Jaccard join: a metric-space join, exact.

A document is its set of distinct hashed shingles; Jaccard distance d = 1 - J is a metric, and documents link when
J >= p / q, that is d <= r. Equal sets are one node from the start, so copies cost nothing.

1. Coarse regions. Pivots alone can't part unrelated texts, all of which are at distance about 1 of each other and of any pivot, so that
   every window holds them all. Hence: sets of sizes a <= b that link differ in at most D elements, D known from a. Cut by hash into
   D + 1 + s parts, they share at least s + 1 whole parts; nodes of a size class that share a non-empty part fall into one
   bucket. (A set with more than s empty parts is cut again by another hash, up to LEVELS times; where all cuts leave
   too many, empty parts count as shared too. Two linked sets thus always meet.) Frequent shingles, as a bounded sample
   shows them, are left out of the parts on both sides, which keeps the bound and makes common passages harmless.
   A node that shares fewer whole parts of each cut than s + 1 and those of its own that are empty has no link; the others, connected by
   shared parts, form regions. In regions of more than LIMIT nodes or LIMIT_BYTES, nodes go of whose elements less than the share p / q is in
   another set of the region: a few elements in common would otherwise connect more and more nodes as the corpus grows.
2. In a region, pivots create Voronoi cells: each node's distance to the pivots is computed, nodes within r of a
   pivot link to it. If x and y link and y lies within r of its pivot, then x lies within 2 r of it: only those boundary nodes
   are compared with the cell's members, and only members whose distances to every pivot are within r of theirs.
3. Regions of more than LIMIT nodes or LIMIT_BYTES are joined recursively, in parallel. Their pivots are some nodes and a virtual
   one, the set of what most of the region's sets have: two sets within r / 2 of it are within r of each other, and so one group, which nodes
   linked to a pivot of the group enter too. Nodes of that group stay only if they lie in every pivot's window about the nodes outside
   it; the rest is dealt to the pivots' cells, boundary nodes (within 2 r of the nearest) to each, where that parts the
   region; cells are regions of the next round. Where no pivot parts a region, its nodes outside the group are compared with all its
   nodes, in shards of SHARD nodes and blocks of BLOCK_BYTES: the group's own pairs never are.

Links found connect the nodes; components come from `graph.components`.

Scale: three passes over the texts, a fourth where regions are large; what is shuffled are part hashes (about (1 - p / q) / (p / q) * 2 a shingle, 12 bytes
each, packed; a range of hashes with about BUCKET of them is looked at together), narrow rows for each document, and the sets of nodes in regions. Tables
and shuffles are deleted as soon as nothing reads them. Regions are dealt in shards of bounded bytes, each with a copy of the pivots; no set
is ever on the driver. Frequent shingles (a bounded array) are broadcast, and tables of ids up to SMALL rows.

Defined cases: null, empty and white-space texts have no set and link with nothing, their component is their own; with
fewer words than a shingle's, the whole sequence is one; rows without doc_id link like others, though their id is nobody's component
(null where no row of the component has one); repeated rows are copies of each other; an empty table gives no rows; further columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sextant.llm.common import SMALL_CHUNK, U64, WORD, cut, drop, groups, mix, read_table, shingle_set, text_bytes, tokens
from sextant.llm.graph import components

LEVELS, MOST_NEED = 4, 31
#: Nodes and bytes up to which a region is one task's, the pivots of larger ones, and how often cells are parted again.
LIMIT, LIMIT_BYTES, PIVOTS, ROUNDS = 2000, 16 << 20, 8, 12
#: Documents from whose shingles frequent ones are told, the share that makes one frequent, and the most of them.
SAMPLE, OFTEN, FREQUENT = 20_000, 1 / 400, 1 << 16
#: Rows up to which ids are broadcast (16 bytes each), bytes of sets in a shard or block, and nodes in a shard.
SMALL, BLOCK_BYTES, SHARD = 500_000, 16 << 20, 512
#: Part hashes that a task holds before it hands them out, and that are looked at together, about.
HELD = BUCKET = 1_000_000
#: What is kept of a node's hash while parts are counted, bits of a part's hash beside those that its bucket tells, and bytes of both with the mark.
NAME, TAG, PLANES = (1 << 48) - 1, U64((1 << 40) - 1), 12


def max_difference(a: int, p: int, q: int) -> int:
    """The most elements in which a set of a elements differs from a linked set that isn't smaller."""
    return (a + a * q // p) * (q - p) // (q + p)


class Scheme:
    """How sets are cut into parts, by size class: bounds[i] <= size < bounds[i + 1]."""

    def __init__(self, p: int, q: int):
        self.p, self.q = p, q
        self.bounds, self.parts, self.slack = [1], [], []
        while self.bounds[-1] < 1 << 32:
            self.bounds.append(self.bounds[-1] * q // p + 1)
            low, d = self.bounds[-2], max_difference(self.bounds[-1] - 1, p, q)
            s = 0
            for _ in range(64):  # the least slack that covers the empty parts to expect, and three times their spread
                m = d + 1 + s
                empty = m * (1 - 1 / m) ** low if m > 1 else 0.0
                more = max(s, math.ceil(empty + 3 * math.sqrt(empty) - 0.3))
                if more == s or more > d // 4:
                    s = s if more == s else 0
                    break
                s = more
            self.parts.append(d + 1 + s if d else 0)
            self.slack.append(s)
        self.edges = np.array(self.bounds)

    def signatures(self, rest: np.ndarray, size: int) -> np.ndarray:
        """Hashes of the parts of a set of `size` elements, of which `rest` are cut; both as the smaller and the larger one of a pair."""
        return self.marked(rest, size)[0]

    def marked(self, rest: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """signatures(), and a byte for each: which cut of the set it is of (three bits), and how many parts of that cut the set shares with others at
        least if it links with any (five bits, at most MOST_NEED). Of s + 1 parts that linked sets share, no more can be empty than are of either set."""
        c = int(np.searchsorted(self.edges, size, "right")) - 1
        out, marks = [np.zeros(0, U64)], [np.zeros(0, np.uint8)]

        def add(sig: np.ndarray, i: int, level: int, need: int) -> None:
            out.append(sig)
            marks.append(np.full(len(sig), ((c - i) * LEVELS + level) | min(max(need, 1), MOST_NEED) << 3, np.uint8))

        for i in (c - 1, c):
            if i < 0 or not self.parts[i]:
                continue
            if i == c - 1 and size > (self.bounds[i + 1] - 1) * self.q // self.p:
                continue  # too large for any set of the class below
            m = self.parts[i]
            for level in range(LEVELS):
                x = rest if not level else np.sort(mix(rest + U64(level)))
                part = (((x >> U64(32)) * U64(m)) >> U64(32)).astype(np.int64)
                first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(x) else np.zeros(0, np.int64)
                tag = U64((i << 40) + (level << 36) + (m << 1))
                full = part[first]
                if len(x):
                    add(mix(np.add.reduceat(mix(x + U64(77)), first) + mix(full.astype(U64) * U64(4099) + tag)), i, level, self.slack[i] + 1 - (m - len(first)))
                if m - len(first) <= self.slack[i]:
                    break
            else:
                none = np.setdiff1d(np.arange(m), full)
                add(mix(mix(none.astype(U64) * U64(4099) + tag) + U64(5)), i, LEVELS - 1, 1)
        return np.concatenate(out), np.concatenate(marks)


def sets_of(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The shingle set of each text, ascending hashes."""
    data, offsets = text_bytes(column)
    for a, b in groups(offsets, SMALL_CHUNK):
        _, _, h, at = tokens(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        for i in range(b - a):
            yield shingle_set(h[at[i] : at[i + 1]], k)


def node_of(s: np.ndarray) -> int:
    """One 64-bit hash for a whole set."""
    return int(mix(np.array([mix(s ^ U64(0xABCDEF)).sum() + U64(len(s))], U64)).view(np.int64)[0])


def nodes(docs: DataFrame, k: int) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, n_shingles, node); node is null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, node = [], []
            for s in sets_of(b.column(1), k):
                n.append(len(s))
                node.append(node_of(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(node, pa.int64()), b.column(2)], ["doc_id", "n_shingles", "node", "text_hash"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, "doc_id long, n_shingles long, node long, text_hash long")


def frequent(docs: DataFrame, k: int) -> np.ndarray:
    """Shingles of at least OFTEN of a bounded sample of documents. They only steer the cut: any choice gives the same links."""
    count = docs.count()
    if count < 1000:
        return np.zeros(0, U64)
    share = max(1, count // SAMPLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in sets_of(b.column(0), k):
                if len(s):
                    yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64))], ["h"])

    some = docs.filter(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(share)) == 0)
    counted = some.select("text").mapInArrow(run, "h long").groupBy("h").count().filter(F.col("count") >= max(8, int(count / share * OFTEN)))
    return np.sort(cut(counted.orderBy(F.desc("count"), "h").limit(FREQUENT)).toPandas()["h"].to_numpy(np.int64).view(U64))


def _without(s: np.ndarray, common: np.ndarray) -> np.ndarray:
    if not len(common):
        return s
    at = np.minimum(np.searchsorted(common, s), len(common) - 1)
    return s[common[at] != s]


def _packed(tag: np.ndarray, name: np.ndarray, mark: np.ndarray) -> bytes:
    """Ascending numbers of 40 bits, numbers of 48 and bytes, by planes: 12 bytes each, of which what steps are short compresses well."""
    out = np.empty((PLANES, len(tag)), np.uint8)
    out[:5] = np.diff(tag, prepend=U64(0)).view(np.uint8).reshape(-1, 8)[:, :5].T
    out[5:11] = name.view(np.uint8).reshape(-1, 8)[:, :6].T
    out[11] = mark
    return out.tobytes()


def _unpacked(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    planes = np.frombuffer(block, np.uint8).reshape(PLANES, -1)
    both = np.zeros((2, planes.shape[1], 8), np.uint8)
    both[0, :, :5], both[1, :, :6] = planes[:5].T, planes[5:11].T
    tag, name = both.view(U64)[:, :, 0]
    return np.cumsum(tag, dtype=U64), name, planes[11]


def part_hashes(docs: DataFrame, k: int, p: int, q: int, common: np.ndarray, buckets: int = 1) -> DataFrame:
    """docs (text) -> (bucket, block): of each node's parts the hash, the node's name and the mark, HELD at a time, packed by ranges of the hash."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def combined(sigs: list[np.ndarray], marks: list[np.ndarray], own: list[int]) -> pa.RecordBatch:
        """Empties the lists: a task's part hashes are held once, and not while its rows are sent."""
        sig, mark = np.concatenate(sigs), np.concatenate(marks)
        name = np.repeat(np.array(own, np.int64).view(U64) & U64(NAME), [len(x) for x in sigs])
        for x in (sigs, marks, own):
            x.clear()
        bucket = ((sig >> U64(32)) * U64(buckets)) >> U64(32)
        sig &= TAG
        order = np.lexsort((sig, bucket))
        sig, mark, name, bucket = sig[order], mark[order], name[order], bucket[order]
        del order
        first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        blocks = [_packed(sig[a:b], name[a:b], mark[a:b]) for a, b in zip(first, np.r_[first[1:], len(sig)], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(bucket[first].astype(np.int32)), pa.array(blocks, pa.binary())], ["bucket", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scheme, f = Scheme(p, q), shared.value
        sigs, marks, own, size, seen = [], [], [], 0, set()
        for b in batches:
            for s in sets_of(b.column(0), k):
                if not len(s) or (node := node_of(s)) in seen:
                    continue
                seen.add(node)
                x, mark = scheme.marked(_without(s, f), len(s))
                sigs.append(x)
                marks.append(mark)
                own.append(node)
                size += len(x)
                if size > HELD:
                    yield combined(sigs, marks, own)
                    size, seen = 0, set()
        if size:
            yield combined(sigs, marks, own)

    return docs.select("text").mapInArrow(run, "bucket int, block binary")


def shared_parts(parts: DataFrame) -> DataFrame:
    """Of part_hashes(), those parts that several nodes have, each once for each node; their hashes are numbers within the bucket from here on."""

    def run(rows: pa.Table) -> pa.Table:
        tag, name, mark = (np.concatenate(x) for x in zip(*(_unpacked(b.as_py()) for b in rows.column(1)), strict=True))
        order = np.lexsort((name, tag))
        tag, name, mark = tag[order], name[order], mark[order]
        once = np.r_[True, (tag[1:] != tag[:-1]) | (name[1:] != name[:-1])]
        tag, name, mark = tag[once], name[once], mark[once]
        new = np.r_[True, tag[1:] != tag[:-1]]
        several = np.diff(np.r_[np.flatnonzero(new), len(tag)]) > 1
        group = np.cumsum(new) - 1
        keep = several[group]
        blocks = [_packed(group[keep].astype(U64), name[keep], mark[keep])] if keep.any() else []
        return pa.table({"bucket": rows.column(0).slice(0, len(blocks)), "block": pa.array(blocks, pa.binary())})

    return parts.groupBy("bucket").applyInArrow(run, "bucket int, block binary")


def _part_rows(parts: DataFrame) -> DataFrame:
    """(part, name, cut, need) of shared_parts()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for bucket, block in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                group, name, mark = _unpacked(block.as_py())
                part = (group + U64(bucket << 32)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(name.view(np.int64)), pa.array((mark & 7).astype(np.int32)), pa.array((mark >> 3).astype(np.int32))], ["part", "name", "cut", "need"])

    return parts.mapInArrow(run, "part long, name long, cut int, need int")


def regions_of(docs: DataFrame, table: DataFrame, k: int, p: int, q: int) -> DataFrame:
    """(name, region) of the nodes that may link: those that share as many parts with others as linked sets do, connected by shared parts."""
    n = table.agg(F.sum("n_shingles")).first()[0] or 0
    parts = cut(shared_parts(part_hashes(docs, k, p, q, frequent(docs, k), max(1, -(-n * 2 * (q - p) // p // BUCKET)))))
    able = cut(_part_rows(parts).groupBy("name", "cut").agg(F.count("*").alias("c"), F.min("need").alias("need")).filter("c >= need").select("name").distinct())
    rows = _part_rows(parts).select("part", "name").join(_hinted(able, able.count()), "name", "left_semi")
    met = rows.withColumn("lo", F.min("name").over(Window.partitionBy("part"))).filter("name <> lo")
    out = cut(components(met.select(F.col("name").alias("a"), F.col("lo").alias("b"))).select(F.col("node").alias("name"), F.col("root").alias("region")))
    drop(parts)
    drop(able)
    return out


def fetch_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """wanted (doc_id, text_hash, node, region), a row for each node -> (region, node, set): the set's hashes as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, sets = [], []
            for i, s in enumerate(sets_of(b.column(0), k)):
                if len(s) and node_of(s) == b.column(1)[i].as_py():
                    keep.append(i)
                    sets.append(s.tobytes())
            some = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(2).take(some), b.column(1).take(some), pa.array(sets, pa.binary())], ["region", "node", "set"])

    docs = docs.select("doc_id", "text")
    named = wanted.filter("doc_id is not null").drop("text_hash")
    rows = docs.join(F.broadcast(named) if named.count() <= SMALL else named, "doc_id").select("text", "node", "region")
    other = wanted.filter("doc_id is null").drop("doc_id")  # nodes of rows without doc_id only
    if n := other.count():
        lone = docs.filter("doc_id is null").withColumn("text_hash", F.xxhash64("text")).dropDuplicates(["text_hash"])
        rows = rows.union(lone.join(F.broadcast(other) if n <= SMALL else other, "text_hash").select("text", "node", "region"))
    return rows.mapInArrow(run, "region long, node long, set binary")


def shared_counts(pivot: np.ndarray, flat: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How many elements each of the sets flat[first[i]:first[i + 1]] shares with the pivot."""
    at = np.searchsorted(pivot, flat)
    hit = pivot[np.minimum(at, len(pivot) - 1)] == flat
    return np.diff(np.r_[0, np.cumsum(hit)][first])


def majority(flat: np.ndarray, n: int) -> np.ndarray:
    """The elements that more than half of n sets have, ascending."""
    v, c = np.unique(flat, return_counts=True)
    return v[2 * c > n]


class Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


class Overlaps:
    """Sets of a region as what they differ in from `core`, what most of them have: intersections cost the differences only."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate(sets)
        self.core = majority(flat, len(sets))
        rest = flat
        own = np.repeat(np.arange(len(sets)), self.size)
        self.missing = np.zeros(len(sets), np.int64)
        if len(self.core):
            at = np.minimum(np.searchsorted(self.core, flat), len(self.core) - 1)
            inside = self.core[at] == flat
            rest, extra_of = flat[~inside], own[~inside]
            # What each set lacks of the core, by a table of the core's places, a bounded number of sets at a time.
            lacks, lacks_of = [], []
            step = max(1, (1 << 24) // len(self.core))
            for a in range(0, len(sets), step):
                n = min(step, len(sets) - a)
                has = np.zeros((n, len(self.core)), bool)
                some = inside & (own >= a) & (own < a + n)
                has[own[some] - a, at[some]] = True
                i, j = np.nonzero(~has)
                lacks.append(self.core[j])
                lacks_of.append(i + a)
            lacks, lacks_of = np.concatenate(lacks), np.concatenate(lacks_of)
            self.missing = np.bincount(lacks_of, minlength=len(sets))
            rest, own = np.concatenate([rest, lacks]), np.concatenate([extra_of, lacks_of])
            order = np.argsort(own, kind="stable")
            rest, own = rest[order], own[order]
        values, self.flat = np.unique(rest, return_inverse=True)
        self.mark = np.zeros(len(values), bool)
        self.first = np.r_[0, np.cumsum(np.bincount(own, minlength=len(sets)))]

    def of(self, i: int) -> np.ndarray:
        """How many elements each set shares with set i."""
        mine = self.flat[self.first[i] : self.first[i + 1]]
        self.mark[mine] = True
        same = np.diff(np.r_[0, np.cumsum(self.mark[self.flat])][self.first])
        self.mark[mine] = False
        return same + len(self.core) - self.missing - self.missing[i]

    def pair(self, i: int, j: int) -> int:
        a, b = (self.flat[self.first[x] : self.first[x + 1]] for x in (i, j))
        return len(np.intersect1d(a, b, assume_unique=True)) + len(self.core) - int(self.missing[i]) - int(self.missing[j])


def region_links(sets: list[np.ndarray], p: int, q: int) -> list[tuple[int, int]]:
    """Links that connect all linked sets of a region, by index."""
    n = len(sets)
    o = Overlaps(sets)
    size = o.size
    u, links = Union(n), []
    free = np.ones(n, bool)
    owner = np.full(n, -1)
    near: list[tuple[int, np.ndarray]] = []  # boundary nodes of each pivot
    table: list[np.ndarray] = []

    def link(a: int, b: int) -> None:
        if u.join(a, b):
            links.append((a, b))

    if n > 8 and len(o.core):  # a virtual pivot: two sets within r / 2 of it are within r of each other
        both = len(o.core) - o.missing
        ball = np.flatnonzero(2 * q * both >= (p + q) * (size + len(o.core) - both))
        for j in ball[1:]:
            link(int(ball[0]), int(j))

    for i in range(n):
        if not free[i]:
            continue
        if len(links) == n - 1:
            return links
        both = o.of(i)
        whole = size + size[i] - both
        linked = q * both >= p * whole
        for j in np.flatnonzero(linked & (np.arange(n) != i)):
            link(i, int(j))
        owner[linked & free] = len(near)
        free &= ~linked
        # J >= 1 - 2 r, with r = (q - p) / q
        near.append((i, np.flatnonzero(~linked & (q * both >= (2 * p - q) * whole))))
        table.append((1 - both / whole).astype(np.float32))
        if not free.any():
            break
    r = (q - p) / q + 1e-6
    for c, (i, boundary) in enumerate(near):
        members = np.flatnonzero(owner == c)
        members = members[members != i]
        if not len(members):
            continue
        windows = [d for (j, _), d in zip(near, table, strict=True) if j != i][:16]
        for x in boundary:
            root = u.find(int(x))
            if root == u.find(i):
                continue
            some = members[np.abs(table[c][members] - table[c][x]) <= r]
            for d in windows:  # triangle inequality with the other pivots
                some = some[np.abs(d[some] - d[x]) <= r]
            for y in some:
                both = o.pair(int(x), int(y))
                if q * both >= p * (size[x] + size[y] - both):
                    link(int(x), int(y))
                    break
    return links


def _links_of_region(p: int, q: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("node").sort_values("node")
        sets = [np.frombuffer(x, U64) for x in rows["set"]]
        node = rows["node"].to_numpy()
        found = region_links(sets, p, q) if len(sets) > 1 else []
        return pd.DataFrame({"a": [node[i] for i, _ in found], "b": [node[j] for _, j in found]}, dtype="int64")

    return run


def _hinted(df: DataFrame, n: int) -> DataFrame:
    """A table of regions, a row for each, with a hint where there are few."""
    return F.broadcast(df) if n <= SMALL else df


def _shards(n: Column, nbytes: Column, most: int = SHARD) -> Column:
    return F.greatest(F.ceil(nbytes / BLOCK_BYTES), F.ceil(n / most)).cast("int")


def _shard(shards: str) -> Column:
    return F.pmod(F.xxhash64("node"), F.col(shards)).cast("int")


def _pivots(big: DataFrame, sizes: DataFrame, n: int, salt: int) -> DataFrame:
    """(region, k, set, id) of large regions: k = 0 the virtual pivot, the set of what most sets have; then PIVOTS nodes at most."""
    core = _counted(big).join(_hinted(sizes, n), "region").filter(F.col("c") * 2 > F.col("n")).groupBy("region").agg(F.array_sort(F.collect_list("h")).alias("hs"))
    h = F.xxhash64("node", F.lit(salt))
    chosen = big.groupBy("region", F.pmod(h, F.lit(PIVOTS)).alias("k")).agg(F.min(F.struct(h.alias("h"), "node"))["node"].alias("node"))  # aggregated before the shuffle
    chosen = cut(chosen)
    chosen = big.join(F.broadcast(chosen) if chosen.count() <= SMALL else chosen, ["region", "node"]).select("region", (F.col("k") + 1).cast("int").alias("k"), "set", F.col("node").alias("id"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.sort(np.array(x, np.int64).view(U64)).tobytes() for x in b.column(1).to_pylist()]
            zeros = np.zeros(b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(zeros.astype(np.int32)), pa.array(sets, pa.binary()), pa.array(zeros.astype(np.int64))], ["region", "k", "set", "id"])

    return cut(chosen.union(core.mapInArrow(packed, "region long, k int, set binary, id long")))


def _measured(p: int, q: int):
    """Of a shard: each node's distances to the pivots, the pivots that it links with, and whether it is of the main group."""

    def run(rows: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
        sets = [np.frombuffer(x, U64) for x in rows["set"]]
        if not sets:
            return pd.DataFrame({c: pd.Series([], dtype=object) for c in ("region", "node", "set", "distance", "linked", "inner")})
        size = np.array([len(s) for s in sets], np.int64)
        flat, first = np.concatenate(sets), np.r_[0, np.cumsum(size)]
        distance = np.full((len(sets), PIVOTS + 1), np.nan)
        linked = np.zeros((len(sets), PIVOTS + 1), bool)
        inner = np.zeros(len(sets), bool)
        pivots = [(int(k), np.frombuffer(x, U64), int(i)) for k, x, i in zip(pivots["k"], pivots["pivot"], pivots["id"], strict=True)]
        core = next((t for k, t, _ in pivots if k == 0), None)
        ids = np.zeros(PIVOTS + 1, np.int64)
        for k, t, i in sorted(pivots, key=lambda x: x[0]):
            both = shared_counts(t, flat, first) if len(t) else np.zeros(len(sets), np.int64)
            whole = size + len(t) - both
            distance[:, k] = 1 - both / whole
            ids[k] = i
            if k == 0:
                inner = 2 * q * both >= (p + q) * whole
            else:
                linked[:, k] = q * both >= p * whole
                if core is not None:  # linked with a node of the group: of the group
                    c = int(shared_counts(core, t, np.array([0, len(t)]))[0])
                    if 2 * q * c >= (p + q) * (len(t) + len(core) - c):
                        inner = inner | linked[:, k]
        return pd.DataFrame({
            "region": rows["region"].to_numpy(), "node": rows["node"].to_numpy(), "set": rows["set"].to_numpy(),
            "distance": pd.Series(list(np.where(np.isnan(distance), 9.0, distance)), dtype=object), "linked": pd.Series([ids[x] for x in linked], dtype=object), "inner": inner,
        })

    return run


def _round(big: DataFrame, sizes: DataFrame, n: int, p: int, q: int, salt: int) -> tuple[DataFrame, DataFrame]:
    """One parallel round over large regions: links to pivots, and what remains of each (region, node, set, out, parted).

    `out` marks the nodes outside the region's main group; parted: the rows are of cells, regions of their own.
    """
    r = (q - p) / q
    on = _hinted(sizes.select("region", _shards(F.col("n"), F.col("bytes")).alias("shards")), n)
    pivots = _pivots(big, sizes, n, salt)
    left = big.join(on, "region").withColumn("shard", _shard("shards")).drop("shards")
    right = pivots.join(on, "region").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).drop("shards")
    schema = "region long, node long, set binary, distance array<double>, linked array<long>, inner boolean"
    right = right.select(F.col("region").alias("of"), F.col("shard").alias("part"), "k", "id", F.col("set").alias("pivot"))
    d = cut(left.groupBy("region", "shard").cogroup(right.groupBy("of", "part")).applyInPandas(_measured(p, q), schema))
    found = d.select(F.col("node").alias("a"), F.explode("linked").alias("b")).filter("a <> b")
    heads = d.filter("inner").groupBy("region").agg(F.min("node").alias("b"))
    found = found.union(d.filter("inner").select("region", F.col("node").alias("a")).join(_hinted(heads, n), "region").select("a", "b"))
    # Nodes of the main group stay only if they lie in every pivot's window about the nodes outside it.
    most = PIVOTS + 1
    found, whole = cut(found), d
    bounds = d.filter("not inner").groupBy("region").agg(*[f(F.get("distance", F.lit(j))).alias(f"_{w}{j}") for j in range(most) for w, f in (("lo", F.min), ("hi", F.max))])
    d = d.join(_hinted(bounds, n), "region")  # regions without a node outside are done
    inside = F.lit(True)
    for j in range(most):
        inside &= F.get("distance", F.lit(j)).between(F.col(f"_lo{j}") - r - 1e-9, F.col(f"_hi{j}") + r + 1e-9)
    d = d.filter(~F.col("inner") | inside)
    # Voronoi cells, with boundary nodes (within 2 r of the nearest pivot) in each: where they part the region.
    cell = F.filter(F.transform("distance", lambda x, i: F.when(x <= F.array_min("distance") + 2 * r + 1e-9, i)), lambda i: i.isNotNull())
    d = cut(d.select("region", "node", "set", (~F.col("inner")).alias("out"), cell.alias("cells")))
    drop(whole)
    cells = d
    per = d.select("region", F.explode("cells").alias("cell")).groupBy("region", "cell").agg(F.count("*").alias("m"))
    part = per.groupBy("region").agg(F.sum("m").alias("copies"), F.max("m").alias("most")).join(d.groupBy("region").agg(F.count("*").alias("all")), "region")
    part = part.select("region", ((F.col("copies") <= 1.5 * F.col("all")) & (F.col("most") <= 0.8 * F.col("all"))).alias("parted"))
    d = d.join(_hinted(part, n), "region")
    d = d.select("region", "node", "set", "out", "parted", F.explode(F.when(F.col("parted"), F.col("cells")).otherwise(F.array(F.lit(-1)))).alias("cell"))
    region = F.when(F.col("parted"), F.xxhash64("region", "cell", F.lit(salt))).otherwise(F.col("region"))
    rest = cut(d.select(region.alias("region"), "node", "set", "out", "parted"))
    drop(cells)
    return found, rest


def _counted(big: DataFrame) -> DataFrame:
    """(region, h, c): how many sets of a region have an element; counted in the tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by: dict[int, list] = {}
            for region, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                by.setdefault(region, []).append(np.frombuffer(x.as_py(), np.int64))
            for region, sets in by.items():
                h, c = np.unique(np.concatenate(sets), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), region)), pa.array(h), pa.array(c)], ["region", "h", "c"])

    return big.select("region", "set").mapInArrow(run, "region long, h long, c long").groupBy("region", "h").agg(F.sum("c").alias("c"))


def _peeled(big: DataFrame, p: int, q: int) -> DataFrame:
    """The nodes of large regions (region, node, set) that may link: linked sets share the share p / q of either, so that many of a set's elements have
    another set of the region as well. What met by parts of a few common elements goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for region, node, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                h = np.frombuffer(x.as_py(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), region)), pa.array(np.full(len(h), node)), pa.array(h)], ["region", "node", "h"])

    n = F.count("*").over(Window.partitionBy("region", "h"))
    met = big.mapInArrow(run, "region long, node long, h long").withColumn("c", n).filter("c > 1").groupBy("region", "node").agg(F.count("*").alias("c"))
    return big.join(met, ["region", "node"]).filter(F.col("c") * q * 8 >= F.octet_length("set") * p).select("region", "node", "set")


def _compared(big: DataFrame, p: int, q: int) -> DataFrame:
    """Links of large regions that no pivot parts: the nodes outside the main group against all nodes, in blocks of bounded bytes.

    A block hands out links that connect, not all that it finds: the main group is one.
    """
    nbytes = F.sum(F.octet_length("set"))
    sizes = big.groupBy("region").agg(_shards(F.count("*"), nbytes, 8 * SHARD).alias("shards"), F.ceil(F.coalesce(F.sum(F.when(F.col("out"), F.octet_length("set"))), F.lit(0)) / BLOCK_BYTES).cast("int").alias("blocks"))
    sizes = cut(sizes.filter("blocks > 0"))
    on = _hinted(sizes, sizes.count())
    left = big.join(on, "region").withColumns({"shard": _shard("shards"), "block": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))}).drop("shards", "blocks")
    right = big.filter("out").select("region", "node", "set").join(on, "region").withColumn("block", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int"))
    right = right.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    right = right.select(F.col("region").alias("of"), F.col("block").alias("of_block"), "part", F.col("node").alias("id"), F.col("set").alias("other"))

    def run(rows: pd.DataFrame, outside: pd.DataFrame) -> pd.DataFrame:
        links: list[tuple[int, int]] = []
        if len(rows) and len(outside):
            ids, sets = outside["id"].to_numpy(), [np.frombuffer(x, U64) for x in outside["other"]]
            size = np.array([len(s) for s in sets], np.int64)
            flat, own = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.int32), size)
            order = np.argsort(flat, kind="stable")
            flat, own = flat[order], own[order]
            up: dict[int, int] = {}

            def find(x: int) -> int:
                while up.setdefault(x, x) != x:
                    up[x] = up[up[x]]
                    x = up[x]
                return x

            main = next((int(x) for x, o in zip(rows["node"], rows["out"], strict=True) if not o), None)
            for node, x, o in zip(rows["node"], rows["set"], rows["out"], strict=True):
                s = np.frombuffer(x, U64)
                lo, hi = np.searchsorted(flat, s, "left"), np.searchsorted(flat, s, "right")
                k = hi - lo
                at = np.repeat(lo - np.r_[0, np.cumsum(k)[:-1]], k) + np.arange(k.sum())
                both = np.bincount(own[at], minlength=len(ids))
                me = int(node) if o else main
                for j in np.flatnonzero(q * both >= p * (size + len(s) - both)):
                    a, c = find(me), find(int(ids[j]))
                    if a != c:
                        up[a] = c
                        links.append((int(node), int(ids[j])))
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return left.groupBy("region", "block", "shard").cogroup(right.groupBy("of", "of_block", "part")).applyInPandas(run, "a long, b long")


def links(docs: DataFrame, table: DataFrame, k: int, p: int, q: int) -> DataFrame:
    """(a, b): links between nodes that connect all linked nodes. table: as nodes() makes it, read more than once."""
    regions = regions_of(docs, table, k, p, q)
    reps = table.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("text_hash").alias("text_hash"), F.max("n_shingles").alias("n"))
    wanted = cut(reps.withColumn("name", F.col("node").bitwiseAND(F.lit(NAME))).join(regions, "name").drop("name"))
    drop(regions)
    found, blocks, work = [], [], None
    for salt in range(ROUNDS + 2):
        left = wanted.select("region", (F.col("n") * 8).alias("b")) if work is None else work.select("region", F.octet_length("set").alias("b"))
        sizes = left.groupBy("region").agg(F.count("*").alias("n"), F.sum("b").alias("bytes"))
        sizes = cut(sizes.filter((F.col("n") > LIMIT) | (F.col("bytes") > LIMIT_BYTES)))
        n = sizes.count()

        def those(how: str) -> DataFrame:
            rows = wanted.drop("n") if work is None else work
            rows = rows.join(_hinted(sizes.select("region"), n), "region", how) if n else rows
            return fetch_sets(docs, rows, k) if work is None else rows

        # Sets of small regions are only shuffled, and one round's shuffle ends before the next one's begins.
        found.append(cut(those("left_anti").select("region", "node", "set").groupBy("region").applyInPandas(_links_of_region(p, q), "a long, b long")))
        if not n:
            break
        big = cut(those("left_semi").select("region", "node", "set"))
        if work is None:
            work = cut(_peeled(big, p, q))
            drop(big)
            continue
        drop(work)
        if salt > ROUNDS:
            blocks.append(big.withColumn("out", F.lit(True)))
            break
        more, rest = _round(big, sizes, n, p, q, salt)
        drop(big)
        found.append(more)
        blocks.append(cut(rest.filter("not parted").drop("parted")))
        work = cut(rest.filter("parted").select("region", "node", "set"))
        drop(rest)
    out = found[0]
    for x in found[1:]:
        out = out.union(x)
    for x in blocks:
        out = out.union(_compared(x, p, q))
    return cut(out)


def jaccard_join(docs: DataFrame, k: int = 5, p: int = 4, q: int = 5) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, n_shingles, component_id, text_hash, root): components of documents linked at J >= p / q.

    root: a key of the component, null for documents without a set."""
    docs = docs.select("doc_id", "text")
    table = cut(nodes(docs, k))
    roots = components(links(docs, table, k, p, q))
    reps = table.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("_least"))
    reps = reps.join(roots.withColumnRenamed("node", "_m"), F.col("node") == F.col("_m"), "left").withColumn("root", F.coalesce("root", "node"))
    groups_ = reps.groupBy(F.col("root").alias("_root")).agg(F.min("_least").alias("_id"))
    ids = cut(reps.join(groups_, F.col("root") == F.col("_root")).select(F.col("node").alias("_node"), "_id", "root"))
    out = table.join(F.broadcast(ids) if ids.count() <= SMALL else ids, F.col("node") == F.col("_node"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("_id", "doc_id").alias("component_id"), "text_hash", "root")


def one_of_each(docs: DataFrame, k: int = 5, p: int = 4, q: int = 5) -> DataFrame:
    """docs with one document of each component, that with the least doc_id; all columns stay. Rows without doc_id go where a row with
    one is of their component; else one of theirs stays. Documents without words stay. Columns named _near_id, _near_hash and _near_own are its own."""
    found = cut(jaccard_join(docs, k, p, q))
    gone = found.filter("doc_id <> component_id").select(F.col("doc_id").alias("_near_id"), F.col("text_hash").alias("_near_hash")).distinct()
    lone = cut(found.filter("doc_id is null and root is not null").select("root", "text_hash", "component_id").distinct())
    if lone.limit(1).count():
        stay = lone.filter("component_id is null").groupBy("root").agg(F.min("text_hash").alias("_s"))
        over = lone.join(stay, "root", "left").filter("component_id is not null or text_hash <> _s")
        gone = gone.union(over.select(F.lit(None).cast("long"), "text_hash"))
    gone = cut(gone)
    gone = F.broadcast(gone) if gone.count() <= SMALL else gone
    kept = docs.withColumn("_near_own", F.xxhash64("text")).join(gone, F.col("doc_id").eqNullSafe(F.col("_near_id")) & (F.col("_near_own") == F.col("_near_hash")), "left_anti")
    again = found.filter("root is not null and (doc_id = component_id or doc_id is null)").groupBy("doc_id", "text_hash").count().filter("count > 1").limit(1).count()
    if again:  # rows that repeat a kept document, doc_id and all
        words = F.regexp_like(F.coalesce("text", F.lit("")), F.lit(WORD))
        kept = kept.filter(words).dropDuplicates(["doc_id", "_near_own"]).unionByName(kept.filter(~words))
    return kept.drop("_near_own")


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(read_table(spark, sf_dir, "documents"), k=3, p=9, q=10).select("doc_id", "n_shingles", "component_id")

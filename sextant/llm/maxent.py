"""LM scoring: a hashed maximum-entropy model with a class-factored softmax.

P(word | history) = P(class | history) * P(group | class, history) * P(word | group). Classes: the end of a text, the most frequent words
one by one, the heaviest two-byte endings, and hashed shares of the other endings; but for those of one word, a class is dealt into
GROUPS groups by the word's hash. Both factors are softmaxes over hashed features. Of the class: the previous word, the word before
it (a skip), and the classes of both (a bigram of classes). Of the group: the class with the previous word, and with the word before it (a
bigram and a skip bigram). Within a group, add-one counts over all training tokens, one place being
for unknown words, so that the probabilities of all words and of an unknown one sum to one.

The tables of hashed features grow with the corpus: a row or more for each distinct training word, up to 2 ** MOST_BITS rows (a model of
2 ** MOST_BITS * (CLASSES + GROUPS) numbers, 8 MB as they travel, is what a broadcast bears; beyond it more histories share a row).

Training: bias terms start at the counts' shares, then every training text is seen once, in ROUNDS slices.
In a round each task starts from the shared weights, makes mini-batch gradient updates over its texts, and hands
out what it changed, by row with how often it met the row. Changes are averaged by these numbers, in blocks on the executors, so that
a history that few tasks meet isn't thinned out by the others; the model goes to the next round. A task has TOKENS tokens or more, so that what it hands out is
in proportion to what it reads; a round has TASKS tasks at most.

Counts are exact and grow with the corpus: words are counted by 64-bit hash within a task, then by a shuffle. The most
frequent words, HEAD at most, travel as arrays; the tokens of all others are looked up by a join on the word, with
tokens summed by (text, word) beforehand. No word, source or text is held in one place.

Defined cases: null and empty texts are one end token; a null doc_id counts as held in (its crc32 is null) and keeps its row;
repeated rows are scored and counted each; without training tokens every word is unknown and the classes are equally
likely; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.llm.common import U64, crc_mod, cut, groups, mix, read_table, text_bytes, tokens

HEAD = 1 << 17
LEAST_BITS, MOST_BITS = 12, 16
WORDS, ENDINGS, OTHERS = 15, 24, 8
CLASSES = 1 + WORDS + ENDINGS + OTHERS
GROUPS = 16
ROUNDS, BATCH, RATE = 3, 4096, 1.0
#: Training tokens of a task (over all rounds), and the most tasks of a round.
TOKENS, TASKS = 1_500_000, 4096
#: Rows of a table that are averaged together, and the largest logit.
BLOCK, EDGE = 512, 40.0
END = U64(0x1234567F00D5EED1)
_LOW = np.arange(256)
_LOW[65:91] += 32
_FEATURES = [U64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93)]


def stream(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tokens of some texts, an end after each: hashes, endings (-1: the end), and where each text begins (one more)."""
    s, e, h, at = tokens(data, offsets)
    n = len(offsets) - 1
    size = np.diff(at)
    first = at + np.arange(n + 1)
    hashes, endings = np.full(int(first[-1]), END, U64), np.full(int(first[-1]), -1, np.int64)
    place = np.arange(len(s)) + np.repeat(np.arange(n), size)
    hashes[place] = h
    if len(s):
        endings[place] = _LOW[data[e - 1]] + 256 * np.where(e - s > 1, _LOW[data[np.maximum(e - 2, 0)]], 0)
    return hashes, endings, first


@dataclass
class Model:
    """What scoring needs; every array has a fixed or bounded size."""

    tops: np.ndarray  # hashes of the words that are classes, ascending
    top_class: np.ndarray
    ending_class: np.ndarray  # by ending
    head: np.ndarray  # hashes of the most frequent words, ascending
    head_count: np.ndarray
    group_log: np.ndarray  # log10 of tokens + words + 1 of each (class, group)
    by_class: np.ndarray  # (rows, CLASSES)
    by_group: np.ndarray  # (rows, GROUPS)
    class_bias: np.ndarray
    group_bias: np.ndarray  # (CLASSES, GROUPS)
    n: int
    v: int

    def packed(self) -> Model:
        """With the tables in half precision, as they travel."""
        return Model(**{**vars(self), "by_class": self.by_class.astype(np.float16), "by_group": self.by_group.astype(np.float16)})

    def unpacked(self) -> Model:
        """A copy to work with."""
        return Model(**{**vars(self), "by_class": self.by_class.astype(np.float32), "by_group": self.by_group.astype(np.float32), "class_bias": self.class_bias.copy()})

    def classes(self, hashes: np.ndarray, endings: np.ndarray) -> np.ndarray:
        c = np.where(endings < 0, 0, self.ending_class[endings])
        if len(self.tops):
            k = np.minimum(np.searchsorted(self.tops, hashes), len(self.tops) - 1)
            c = np.where(self.tops[k] == hashes, self.top_class[k], c)
        return c

    def features(self, hashes: np.ndarray, cls: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
        """Rows of each token's history, three of by_class and two of by_group; histories don't cross texts."""
        n = len(hashes)
        place = np.arange(n) - np.repeat(first[:-1], np.diff(first))
        c = (cls + 1).astype(U64)

        def back(x: np.ndarray, k: int) -> np.ndarray:
            y = np.zeros_like(x)
            y[k:] = x[:-k] if k < n else x[:0]
            return np.where(place >= k, y, U64(0)) if k < n else np.zeros_like(x)

        w1, w2 = back(hashes, 1), back(hashes, 2)
        raw = (w1, w2, mix(back(c, 1) + back(c, 2) * U64(1009)), mix(w1 + c * U64(100003)), mix(w2 + c * U64(300007)))
        shift = U64(64 - (len(self.by_class) - 1).bit_length())
        return [(((x + U64(k + 1)) * _FEATURES[k]) >> shift).astype(np.uint16) for k, x in enumerate(raw)]  # sorted fast

    def class_logits(self, rows: list[np.ndarray]) -> np.ndarray:
        return _logits(self.by_class, rows[:3], self.class_bias)

    def group_logits(self, rows: list[np.ndarray], cls: np.ndarray) -> np.ndarray:
        return _logits(self.by_group, rows[3:], self.group_bias[cls])

    def log10(self, rows: list[np.ndarray], cls: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Of each token, log10 of the probability of its class and group; classes of one word have no groups."""
        out = np.empty(len(cls))
        for a in range(0, len(cls), BATCH):
            some, c = [r[a : a + BATCH] for r in rows], cls[a : a + BATCH]
            p = _log_chosen(self.class_logits(some), c)
            m = np.flatnonzero(c > WORDS)
            p[m] += _log_chosen(self.group_logits([r[m] for r in some], c[m]), group[a : a + BATCH][m])
            out[a : a + BATCH] = p
        return out / np.log(10)

    def learn(self, rows: list[np.ndarray], cls: np.ndarray, group: np.ndarray, rate: float, met: tuple[np.ndarray, np.ndarray]) -> None:
        """One gradient step for each mini-batch; steps are normalised by how often the batch has a row. met counts rows."""
        for a in range(0, len(cls), BATCH):
            some, c = [r[a : a + BATCH] for r in rows], cls[a : a + BATCH]
            p = _errors(self.class_logits(some), c)
            for r in some[:3]:
                _step(self.by_class, r, p, rate, met[0])
            self.class_bias -= rate / np.sqrt(len(c)) * p.sum(0) * 0.1
            m = np.flatnonzero(c > WORDS)
            if len(m):
                some = [r[m] for r in some]
                p = _errors(self.group_logits(some, c[m]), group[a : a + BATCH][m])
                for r in some[3:]:
                    _step(self.by_group, r, p, rate, met[1])


def _logits(table: np.ndarray, rows: list[np.ndarray], bias: np.ndarray) -> np.ndarray:
    """Sums of the rows, held within EDGE so that their exponentials need no scaling."""
    z = np.take(table, rows[0], axis=0)
    for r in rows[1:]:
        z += np.take(table, r, axis=0)
    z += bias
    return np.clip(z, -EDGE, EDGE, out=z)


def _log_chosen(z: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """The logarithms of the softmax's chosen entries; z is used up."""
    out = z[np.arange(len(z)), chosen]
    np.exp(z, out=z)
    return out - np.log(z @ np.ones(z.shape[1], np.float32))


def _errors(z: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """The softmax less one at the chosen entries, in place of z."""
    np.exp(z, out=z)
    z /= (z @ np.ones(z.shape[1], np.float32))[:, None]
    z[np.arange(len(z)), chosen] -= 1
    return z


def _step(table: np.ndarray, rows: np.ndarray, errors: np.ndarray, rate: float, met: np.ndarray) -> None:
    order = np.argsort(rows, kind="stable")
    at = rows[order]
    new = np.empty(len(at) + 1, bool)
    new[0] = new[-1] = True
    np.not_equal(at[1:], at[:-1], out=new[1:-1])
    lone = new[:-1] & new[1:]  # rows that the batch has once need no sum
    i = order[lone]
    alone = at[lone]
    table[alone] -= (rate / np.sqrt(5)).astype(np.float32) * errors[i]
    met[alone] += 1
    many = ~lone
    if many.any():
        at, order = at[many], order[many]
        first = np.flatnonzero(new[:-1][many])
        count = np.diff(np.append(first, len(at))).astype(np.float32)
        g = np.add.reduceat(errors[order], first, axis=0)
        g *= (rate / np.sqrt(count + 4))[:, None]
        at = at[first]
        table[at] -= g
        met[at] += count


def groups_of(hashes: np.ndarray) -> np.ndarray:
    """The group of a word in its class: from its hash alone."""
    return (mix(hashes ^ U64(0x5DEECE66D)) % U64(GROUPS)).astype(np.int64)


def _chunks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, int, int, np.ndarray, np.ndarray]]:
    for b in batches:
        data, offsets = text_bytes(b.column(column))
        for x, y in groups(offsets):
            yield b, x, y, data[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x]


def word_counts(docs: DataFrame) -> DataFrame:
    """docs (text) -> (word, ending, n): every token counted, the end of a text among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            h, e, n = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(h)
            h, e, n = h[order], e[order], n[order]
            first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            held[:] = [(h[first], e[first], np.add.reduceat(n, first))]
            return held[0]

        def batch() -> pa.RecordBatch:
            h, e, n = merged()
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(e.astype(np.int32)), pa.array(n)], ["word", "ending", "n"])

        size = 0
        for _, _, _, data, offsets in _chunks(batches, 0):
            h, e, _ = stream(data, offsets)
            u, first, n = np.unique(h, return_index=True, return_counts=True)
            held.append((u, e[first], n))
            size += len(u)
            if size > 1_500_000:  # memory stays bounded, whatever the partition
                size = len(merged()[0])
                if size > 1_000_000:
                    yield batch()
                    size = 0
        if held:
            yield batch()

    rows = docs.select("text").mapInArrow(run, "word long, ending int, n long")
    return rows.groupBy("word").agg(F.max("ending").alias("ending"), F.sum("n").alias("n"))


def start(counts: DataFrame) -> Model:
    """Classes and counts, before training. Collected: HEAD words at most, a row for each two-byte ending (65,537 at most), a row for
    each class and group, and one for each step of a scale of counts (exact up to 4096, then by 1/256 of a power of e: under 16,000)."""
    by_ending = counts.groupBy("ending").agg(F.sum("n").alias("n"), F.count("*").alias("v")).toPandas().sort_values("ending")
    step = F.when(F.col("n") <= 4096, F.col("n")).otherwise(4096 - 2129 + F.floor(F.log("n") * 256))
    scale = counts.groupBy(step.alias("s")).agg(F.min("n").alias("least"), F.count("*").alias("k")).toPandas().sort_values("s", ascending=False)
    fits = scale[scale["k"].cumsum() <= HEAD]
    least = int(fits["least"].min()) if len(fits) else 1 << 62
    head = counts.filter(F.col("n") >= least).toPandas().sort_values(["n", "word"], ascending=[False, True])
    words = head[head["ending"] >= 0].head(WORDS)
    n, v = by_ending["n"].to_numpy(np.int64, copy=True), by_ending["v"].to_numpy(np.int64, copy=True)
    ending = by_ending["ending"].to_numpy(np.int64)
    total, kinds = int(n.sum()), int(v.sum())
    for e, k in zip(words["ending"], words["n"], strict=True):  # words that are classes leave their ending's class
        n[np.searchsorted(ending, e)] -= k
    order = [i for i in np.lexsort((ending, -n)) if ending[i] >= 0]
    ending_class = 1 + WORDS + ENDINGS + (mix(np.arange(65536, dtype=U64)) % U64(OTHERS)).astype(np.int64)
    for rank, i in enumerate(order[:ENDINGS]):
        ending_class[ending[i]] = 1 + WORDS + rank
    tops = words["word"].to_numpy(np.int64).view(U64)
    sort = np.argsort(tops)
    h = head["word"].to_numpy(np.int64).view(U64)
    by_hash = np.argsort(h)
    bits = min(MOST_BITS, max(LEAST_BITS, (kinds - 1).bit_length()))
    model = Model(
        tops[sort], 1 + sort, ending_class, h[by_hash], head["n"].to_numpy(np.int64)[by_hash], np.zeros((CLASSES, GROUPS)),
        np.zeros((1 << bits, CLASSES), np.float32), np.zeros((1 << bits, GROUPS), np.float32), np.zeros(CLASSES, np.float32), np.zeros((CLASSES, GROUPS), np.float32), total, kinds,
    )
    size, different = group_sizes(counts, model)
    model.group_log = np.log10(size + different + 1)
    model.class_bias = np.log((size.sum(1) + 1) / (total + CLASSES)).astype(np.float32)
    model.group_bias = np.log((size + 1) / (size.sum(1, keepdims=True) + GROUPS)).astype(np.float32)
    return model


def group_sizes(counts: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and distinct words of each class and group; classes of one word have one group, the first."""
    shared = counts.sparkSession.sparkContext.broadcast((model.tops, model.top_class, model.ending_class))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops, top_class, ending_class = shared.value
        m = Model(tops, top_class, ending_class, *[np.zeros(0)] * 7, 0, 0)
        size, kinds = np.zeros(CLASSES * GROUPS, np.int64), np.zeros(CLASSES * GROUPS, np.int64)
        for b in batches:
            h, e, n = (b.column(k).to_numpy() for k in range(3))
            cls = m.classes(h.view(U64), e)
            at = cls * GROUPS + np.where(cls > WORDS, groups_of(h.view(U64)), 0)
            np.add.at(size, at, n)
            kinds += np.bincount(at, minlength=len(kinds))
        some = np.flatnonzero(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(size[some]), pa.array(kinds[some])], ["at", "n", "v"])

    got = counts.select("word", "ending", "n").mapInArrow(run, "at long, n long, v long").groupBy("at").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()
    size, kinds = np.zeros(CLASSES * GROUPS), np.zeros(CLASSES * GROUPS)
    for r in got:
        size[r["at"]], kinds[r["at"]] = r["n"], r["v"]
    return size.reshape(CLASSES, GROUPS), kinds.reshape(CLASSES, GROUPS)


def one_round(docs: DataFrame, model: Model, rate: float) -> Model:
    """Local gradient updates in every task, then the mean of the tasks' changes, row by row by how often each met the row."""
    shared = docs.sparkSession.sparkContext.broadcast(model.packed())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        old = shared.value
        m = old.unpacked()
        met = np.zeros(len(m.by_class), np.float32), np.zeros(len(m.by_group), np.float32)
        n = 0
        for _, _, _, data, offsets in _chunks(batches, 0):
            h, e, first = stream(data, offsets)
            cls = m.classes(h, e)
            m.learn(m.features(h, cls, first), cls, groups_of(h), rate, met)
            n += len(h)
        if not n:
            return
        names = ["block", "rows", "met", "change"]
        bias = (m.class_bias - old.class_bias).astype(np.float16)
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in (np.zeros(1, np.uint16), np.array([n], np.float32), bias))], names)
        for t, (new, start_) in enumerate(((m.by_class, old.by_class), (m.by_group, old.by_group))):
            out: list[list] = [[], [], [], []]
            rows = np.flatnonzero(met[t])
            edges = np.searchsorted(rows, np.arange(0, len(new) + 1, BLOCK))
            for k in np.flatnonzero(np.diff(edges)):
                at = rows[edges[k] : edges[k + 1]]
                for column, x in zip(out, (t * (1 << 32) + k, (at - k * BLOCK).astype(np.uint16).tobytes(), met[t][at].tobytes(), (new[at] - start_[at]).astype(np.float16).tobytes()), strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), *(pa.array(x, pa.binary()) for x in out[1:])], names)

    def mean(rows: pd.DataFrame) -> pd.DataFrame:
        width = len(rows["change"].iloc[0]) // 2 // (len(rows["rows"].iloc[0]) // 2)
        total, weight = np.zeros((BLOCK, width)), np.zeros(BLOCK)
        for r, w, x in zip(rows["rows"], rows["met"], rows["change"], strict=True):
            at, w = np.frombuffer(r, np.uint16), np.frombuffer(w, np.float32)
            total[at] += np.frombuffer(x, np.float16).reshape(-1, width) * w[:, None]
            weight[at] += w
        at = np.flatnonzero(weight)
        return pd.DataFrame({"block": rows["block"].iloc[:1], "rows": [at.astype(np.uint16).tobytes()], "change": [(total[at] / weight[at, None]).astype(np.float16).tobytes()]})

    some = docs.select("text").coalesce(max(1, min(TASKS, model.n // TOKENS)))
    got = some.mapInArrow(run, "block long, rows binary, met binary, change binary").groupBy("block").applyInPandas(mean, "block long, rows binary, change binary").toPandas()
    shared.destroy()  # every task of the round is done
    out = model.unpacked()
    for block, rows, change in zip(got["block"], got["rows"], got["change"], strict=True):
        at, x = np.frombuffer(rows, np.uint16), np.frombuffer(change, np.float16)
        if block < 0:
            out.class_bias += x
        else:
            table, k = (out.by_class, out.by_group)[block >> 32], block & 0xFFFFFFFF
            table[k * BLOCK + at.astype(np.int64)] += x.reshape(len(at), -1)
    return out


def train(docs: DataFrame) -> tuple[Model, DataFrame]:
    """The model and all word counts (word, n) of docs (doc_id, text)."""
    counts = cut(word_counts(docs))
    model = start(counts)
    for k in range(ROUNDS):
        part = docs.filter(F.pmod(F.xxhash64("doc_id", F.lit(99)), F.lit(ROUNDS)) == k)
        model = one_round(part, model, RATE / (k + 1))
    return model, counts.select("word", "n")


def score(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, n_tokens, n_known, train_tokens, base_score, score), scores in log10."""
    shared = docs.sparkSession.sparkContext.broadcast(model.packed())
    names = ["word", "row", "doc_id", "n_tokens", "tail", "n_known", "base_score", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, row = shared.value.unpacked(), TaskContext.get().partitionId() << 33
        floor = np.log10(m.n + m.v + 1)
        for b, x, y, data, offsets in _chunks(batches, 1):
            h, e, first = stream(data, offsets)
            cls = m.classes(h, e)
            group = np.where(cls > WORDS, groups_of(h), 0)
            logp = m.log10(m.features(h, cls, first), cls, group)
            at = np.minimum(np.searchsorted(m.head, h), max(len(m.head) - 1, 0))
            known = m.head[at] == h if len(m.head) else np.zeros(len(h), bool)
            up = np.where(known, np.log10(m.head_count[at] + 1.0) if len(m.head) else 0.0, 0.0)
            base = up - floor
            own = up - m.group_log[cls, group] + logp
            n, doc = y - x, np.repeat(np.arange(y - x), np.diff(first))
            ids = row + np.arange(n)
            row += n
            sums = [np.add.reduceat(v, first[:-1]) for v in (known.astype(np.int64), base, own)]
            columns = [ids, ids, None, np.diff(first), np.zeros(n, np.int64), *sums]
            yield pa.RecordBatch.from_arrays([b.column(0).slice(x, n) if c is None else pa.array(c) for c in columns], names)
            # Tokens of rarer words, summed by (text, word), go to the join.
            if m.v > len(m.head) and not known.all():
                t = np.flatnonzero(~known)
                w, d = h[t], doc[t]
                order = np.lexsort((d, w))
                w, d = w[order], d[order]
                new = np.flatnonzero(np.r_[True, (w[1:] != w[:-1]) | (d[1:] != d[:-1])])
                k = len(new)
                zeros = np.zeros(k)
                columns = [w[new].view(np.int64), ids[d[new]], None, np.zeros(k, np.int64), np.diff(np.r_[new, len(w)]), np.zeros(k, np.int64), zeros, zeros]
                yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()) if c is None else pa.array(c) for c in columns], names)

    rows = docs.select("doc_id", "text").mapInArrow(run, "word long, row long, doc_id long, n_tokens long, tail long, n_known long, base_score double, score double")
    # A text's own row joins nothing: its key, a row number, goes with tail = 0.
    c = counts.select(F.col("word").alias("_w"), F.col("n").alias("_n"))
    rows = rows.join(c, (F.col("word") == F.col("_w")) & (F.col("tail") > 0), "left")
    up = F.col("tail") * F.log10(F.coalesce("_n", F.lit(0)) + 1)
    seen = F.when(F.col("_n") > 0, F.col("tail")).otherwise(0)
    out = rows.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("n_known") + seen).alias("n_known"),
        F.sum(F.col("base_score") + up).alias("base_score"),
        F.sum(F.col("score") + up).alias("score"),
    )
    return out.select("doc_id", "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(crc_mod(doc_id, 7) == 2, F.lit(False))


def op1_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model, counts = train(docs.filter(~held_out(F.col("doc_id"))))
    out = score(docs, model, counts)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")

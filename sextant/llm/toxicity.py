"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word's subwords are its bytes' n-grams (3 to 6, with a border mark on either side) and the whole word, each hashed to
one of 2 ** BITS embedding rows. A bag's vector is the mean of its words' (each the mean of its subwords'), and a linear softmax
over two classes scores it. Bags are the single words and the whole text: a text's score is a logistic function of its averaged
bag, its two highest words and the logarithm of its length, so that a few words aren't lost in a long text, and a
long clean text isn't rejected for the one odd word that it must have. Every word of the whole text counts.

Rows and softmax are trained together (Adagrad, mini-batches) on words of the labelled texts, a share of each text's. A toxic
text is mostly clean words: after WARM epochs only those of its words that the model so far scores highest (TOP of them) stand for its
label, and half of a clean text's are its highest ones. Misspellings that were never seen share most n-grams with the
words they come from, and so their vectors.

Since softmax(mean(E[b]) W) depends on a row only by E[b] (W1 - W0), a trained model folds exactly into one number a
row (2 ** BITS floats, a fixed size), which is what is broadcast for scoring. Scoring is one pass over the
texts in Arrow batches, without a shuffle; memory is bounded by a chunk of about a quarter of a megabyte (or one text).

Training takes at most `most_rows` labelled rows that have a document, in the order of a hash of doc_id (a documented bound: 6000).

Defined cases: null and empty texts score as a text without words; rows whose label is null aren't learnt from;
a doc_id with several labels learns from one row (the larger label); with no label of one class the score is the share of
label 1 (0.5 without labels); equal texts score alike; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.llm.common import SMALL_CHUNK, U64, crc_mod, groups, mix, powers, read_table, text_bytes, tokens

BITS = 18
NGRAMS = (3, 4, 5, 6)
#: Words of a text that an epoch learns from: at least so many, and this share (clean, toxic texts); epochs that draw them at random.
LEAST, SHARE, WARM = (12, 60), (0.02, 0.2), 3
#: The share of a toxic text's words that stand for its label after those epochs, the decay of the rows.
TOP, DECAY = 0.1, 1e-3
#: Words whose subwords are held at a time.
WORDS = 1 << 13
_BYTES = mix(np.arange(300, 557, dtype=np.uint64))  # 256: a word's border
_LOW = np.r_[np.arange(65), np.arange(97, 123), np.arange(91, 257)]


def word_rows(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Subword rows of the words data[starts:ends], and how many each word has."""
    size = ends - starts + 2
    first = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(size, out=first[1:])
    total = int(first[-1])
    code = np.full(total, 256, np.int64)
    inner = np.ones(total, bool)
    inner[first[:-1]] = False
    inner[first[1:] - 1] = False
    at = np.arange(total) - np.repeat(first[:-1], size) + np.repeat(starts, size) - 1
    code[inner] = _LOW[data[at[inner]]]
    p, q = powers(total + 1)
    c = np.zeros(total + 1, U64)
    np.cumsum(_BYTES[code] * p[:total], out=c[1:])
    word, place = np.repeat(np.arange(len(starts)), size), np.arange(total)
    left = np.repeat(first[1:], size) - place
    ids, of = [], []
    for n in NGRAMS:
        i = np.flatnonzero(left >= n)
        ids.append((c[i + n] - c[i]) * q[i] + U64(n))
        of.append(word[i])
    ids.append((c[first[1:]] - c[first[:-1]]) * q[first[:-1]] + U64(99))
    of.append(np.arange(len(starts)))
    ids, of = np.concatenate(ids), np.concatenate(of)
    order = np.argsort(of, kind="stable")
    return (mix(ids[order]) & U64((1 << BITS) - 1)).astype(np.int64), np.bincount(of, minlength=len(starts))


def distinct_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the distinct words, each token's word, each text's first token, and tokens by text."""
    starts, ends, h, at = tokens(data, offsets)
    _, first, which = np.unique(h, return_index=True, return_inverse=True)
    return starts[first], ends[first], which, at[:-1], np.diff(at)


@dataclass
class Model:
    """weight: what each row adds to a bag's logit of class 1 over class 0, bias: the logit of a bag without words.

    A text's logit is offset + slopes * (its highest word's, the second highest's, its averaged bag's, log(1 + words)).
    """

    weight: np.ndarray
    bias: float
    offset: float = 0.0
    slopes: tuple[float, ...] = (0.0, 0.0, 1.0, 0.0)

    def words(self, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        out = np.zeros(len(s))
        for a in range(0, len(s), WORDS):
            rows, k = word_rows(data, s[a : a + WORDS], e[a : a + WORDS])
            out[a : a + WORDS] = _means(self.weight, rows, np.r_[0, np.cumsum(k)])
        return out

    def signals(self, texts: pa.Array) -> np.ndarray:
        """Of each text: the logits of its two highest words (the bias where there is none) and of its averaged bag, log(1 + words)."""
        data, offsets = text_bytes(texts)
        out = np.full((len(offsets) - 1, 4), self.bias)
        out[:, 3] = 0
        for a, b in groups(offsets, SMALL_CHUNK):
            part, offs = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            s, e, which, at, n = distinct_words(part, offs)
            if not len(which):
                continue
            value = self.words(part, s, e)[which] + self.bias
            some = np.flatnonzero(n)
            lead, doc = at[some], np.repeat(np.arange(len(some)), n[some])
            out[a + some, 2] = np.add.reduceat(value, lead) / n[some]
            out[a + some, 3] = np.log1p(n[some])
            out[a + some, 0] = high = np.maximum.reduceat(value, lead)
            at_high = np.flatnonzero(value == high[doc])
            value[at_high[np.unique(doc[at_high], return_index=True)[1]]] = -np.inf  # once
            out[a + some, 1] = np.where(n[some] > 1, np.maximum.reduceat(value, lead), self.bias)
        return out

    def scores(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.offset + self.signals(texts) @ np.array(self.slopes), -60, 60)))


def _bags(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Of each text: its tokens as indices of the distinct words of all texts; those words' rows, and where each word's begin (one more at
    the end). A word's rows are held once, however many texts have it."""
    data, offsets = text_bytes(pa.array([(t or "").encode("utf-8", "replace") for t in texts], pa.large_binary()))
    known, number = np.zeros(0, U64), np.zeros(0, np.int32)  # hashes of the words so far, ascending, and their indices
    tokens_, rows, counts = [], bytearray(), []
    for a, b in groups(offsets):
        part = data[offsets[a] : offsets[b]]
        s, e, h, at = tokens(part, offsets[a : b + 1] - offsets[a])
        v, first = np.unique(h, return_index=True)
        new = first[~np.isin(v, known, assume_unique=True)]
        for k in range(0, len(new), WORDS):
            r, n = word_rows(part, s[new[k : k + WORDS]], e[new[k : k + WORDS]])
            rows += r.astype(np.int32).tobytes()
            counts.append(n)
        number = np.r_[number, np.arange(len(known), len(known) + len(new), dtype=np.int32)]
        known = np.r_[known, h[new]]
        order = np.argsort(known)
        known, number = known[order], number[order]
        tokens_ += np.split(number[np.searchsorted(known, h)], at[1:-1])
    return tokens_, np.frombuffer(rows, np.int32), np.cumsum(np.concatenate([np.zeros(1, np.int64), *counts]))


def _means(weight: np.ndarray, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    """What each word adds to a bag: the mean weight of its rows rows[first[i]:first[i + 1]]."""
    out = np.zeros(len(first) - 1)
    for a in range(0, len(out), WORDS):
        at = first[a : a + WORDS + 1]
        out[a : a + WORDS] = np.add.reduceat(weight[rows[at[0] : at[-1]]], at[:-1] - at[0]) / np.diff(at)
    return out


def _picked(w: np.ndarray, rows: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, weights and owner (0, 1, ...) of some tokens, given as words, each a bag of its own."""
    k = first[w + 1] - first[w]
    at = np.repeat(first[w] - np.r_[0, np.cumsum(k)[:-1]], k) + np.arange(k.sum())
    return rows[at], np.repeat(1.0 / k, k).astype(np.float32), np.repeat(np.arange(len(w)), k)


def _drawn(which: np.ndarray, y: int, words: np.ndarray | None, rng: np.random.Generator) -> np.ndarray:
    """The tokens of a text of class y that an epoch learns from; words: what each word adds in the model so far, None in the first epochs."""
    n = len(which)
    k = max(LEAST[y], int(n * SHARE[y]))
    drawn = np.unique(rng.integers(0, n, k))
    if words is None:
        return drawn
    value = words[which]
    if y:
        return np.argsort(-value, kind="stable")[: max(2, int(n * TOP))]
    return np.unique(np.r_[drawn[: k - k // 2], np.argsort(-value, kind="stable")[: k // 2]])


def train(texts: list[str], labels: np.ndarray, dim: int = 8, epochs: int = 8, rate: float = 0.3, seed: int = 3, share: float = 0.2) -> Model:
    """Joint training of embedding rows and softmax on a bounded list of texts, word by word; `share` of them only calibrate."""
    y = np.asarray(labels, np.int64)
    rng = np.random.default_rng(seed)
    part = rng.random(len(y)) < share
    if len(y) < 50 or len(set(y[part])) < 2 or len(set(y[~part])) < 2:
        part[:] = False
    base = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    if len(set(y)) < 2:
        return Model(np.zeros(1 << BITS, np.float32), 0.0, float(np.log(base / (1 - base))), (0.0, 0.0, 0.0, 0.0))
    learn = np.flatnonzero(~part)
    bags, rows_of, first_of = _bags([texts[i] for i in learn])
    bags = {i: b for i, b in zip(learn, bags, strict=True) if len(b)}
    emb = rng.uniform(-0.02, 0.02, (1 << BITS, dim)).astype(np.float32)
    w, b = rng.normal(0, 0.5, (dim, 2)).astype(np.float32), np.zeros(2, np.float32)
    ge, gw, gb = np.full((1 << BITS, 1), 1e-4, np.float32), np.full_like(w, 1e-2), np.full_like(b, 1e-2)
    for epoch in range(epochs):
        lr = rate * (1 - 0.8 * epoch / epochs)
        order = rng.permutation(np.array(list(bags), np.int64))
        words = _means(emb @ (w[:, 1] - w[:, 0]), rows_of, first_of) if epoch >= WARM else None
        for a in range(0, len(order), 32):
            ids, x, bag, lab, seen = [], [], [], [], 0
            for i in order[a : a + 32]:
                r, v, k = _picked(bags[i][_drawn(bags[i], y[i], words, rng)], rows_of, first_of)
                ids.append(r)
                x.append(v)
                bag.append(k + seen)
                seen += k[-1] + 1
                lab.append(np.full(k[-1] + 1, y[i]))
            ids, x, bag, lab = map(np.concatenate, (ids, x, bag, lab))
            h = np.add.reduceat(emb[ids] * x[:, None], np.flatnonzero(np.r_[True, bag[1:] != bag[:-1]]), axis=0)
            z = h @ w + b
            z -= z.max(1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(1, keepdims=True)
            p[np.arange(seen), lab] -= 1
            dh, dw, db = p @ w.T, h.T @ p, p.sum(0)
            sort = np.argsort(ids, kind="stable")
            rows, first = np.unique(ids[sort], return_index=True)
            g = np.add.reduceat(dh[bag[sort]] * x[sort, None], first, axis=0) + DECAY * emb[rows]
            ge[rows] += (g * g).mean(1, keepdims=True)
            emb[rows] -= lr * g / np.sqrt(ge[rows])
            gw += dw * dw
            w -= 0.3 * lr * dw / np.sqrt(gw)
            gb += db * db
            b -= 0.3 * lr * db / np.sqrt(gb)
    model = Model((emb @ (w[:, 1] - w[:, 0])).astype(np.float32), float(b[1] - b[0]))
    held = np.flatnonzero(part) if part.any() else learn
    return calibrate(model, model.signals(pa.array([texts[i] for i in held], pa.string())), y[held])


def calibrate(model: Model, x: np.ndarray, y: np.ndarray) -> Model:
    """Fits the text's logit to its signals by Newton steps with a small ridge."""
    mean, scale = x.mean(0), x.std(0) + 1e-6
    f = np.c_[np.ones(len(y)), (x - mean) / scale]
    ridge = np.r_[1e-3, np.full(x.shape[1], 0.1)]
    c = np.zeros(f.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(f @ c, -30, 30)))
        c -= np.linalg.solve((f.T * (p * (1 - p))) @ f + np.diag(ridge), f.T @ (p - y) + ridge * c)
    slopes = c[1:] / scale
    return Model(model.weight, model.bias, float(c[0] - slopes @ mean), tuple(map(float, slopes)))


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = 6000, **how) -> Model:
    """Learns from at most `most_rows` of the rows of labels (doc_id, toxic) that docs (doc_id, text) have."""
    labels = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    labels = labels.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    some = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)  # bounded, hence broadcast
    ids = [(r.doc_id, int(r.toxic)) for r in some.collect()]
    if not ids:
        return train([], np.zeros(0))
    some = docs.sparkSession.createDataFrame(ids, "doc_id long, toxic int")
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").dropDuplicates(["doc_id"]).select("doc_id", "text", "toxic")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = list(batches)
        if found:
            t = pa.Table.from_batches(found).sort_by("doc_id")
            texts, labels = t["text"].to_pylist(), t["toxic"].to_numpy()
            del found, t
            m = train(texts, labels, **how)
            yield pa.RecordBatch.from_arrays([pa.array([m.weight.tobytes()], pa.binary()), pa.array([m.bias]), pa.array([m.offset]), pa.array([list(m.slopes)], pa.list_(pa.float64()))], ["weight", "bias", "offset", "slopes"])

    # One task learns from the bounded sample, not the driver.
    got = rows.repartition(1).mapInArrow(run, "weight binary, bias double, offset double, slopes array<double>").collect()
    if not got:
        return train([], np.zeros(0))
    m = got[0]
    return Model(np.frombuffer(bytes(m.weight), np.float32), m.bias, m.offset, tuple(m.slopes))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, score)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value.scores(b.column(1)), pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that score under the threshold, with all their columns."""
    shared, schema, at = docs.sparkSession.sparkContext.broadcast(model), docs.schema, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(shared.value.scores(b.column(at)) < threshold))

    return docs.mapInArrow(run, schema)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (read_table(spark, sf_dir, t) for t in ("documents", "labels"))
    held = crc_mod(F.col("doc_id"), 5) == 0
    model = fit(docs, labels.filter(~held))
    return score(docs, model).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

"""The registered queries, every contract column, against plain versions over whole small tables."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sextant.llm import maxent, media, mixing, repeats, sharding, toxicity
from sextant.llm.queries import JACCARD_SQL
from sextant.llm.jaccard import op4_jaccard
from tests.llm.test_operators import THUE, brute_repeats
from tests.llm.util import ODD, empty, odd, tokens


def crc(i, m):
    return zlib.crc32(str(i).encode()) % m


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    rng = random.Random(21)
    words = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(250)]
    shared = " ".join(rng.choice(words) for _ in range(90))
    rows, labels = [], []
    for i in range(200, 520):
        w = [rng.choice(words) for _ in range(rng.randrange(1, 140))]
        toxic = i % 6 == 0
        if toxic:
            w[rng.randrange(len(w))] = rng.choice(["zumplewick", "vroxterian"])
        t = " ".join(w) + (" " + shared if i % 7 == 0 else "")
        rows.append((i, t, "en", f"s{i % 5}" if i % 3 else "hot", len(t)))
        labels.append((i, int(toxic), 1))
    rows += [(600, rows[3][1], "en", "s1", 0), (601, THUE, "en", "s1", 0), (602, THUE.translate(str.maketrans("ab", "ba")), "en", "s1", 0), (603, "é漢😀 " * 300_000, "en", "s1", 0)]
    rows += ODD
    at = str(tmp_path_factory.mktemp("sf"))
    odd(spark, rows).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int, quality int").write.parquet(f"{at}/labels.parquet")
    return at, rows, dict((i, t) for i, t, _ in labels)


def key(i, *more):
    return (str(i), *more)


def test_op1(spark, table):
    at, rows, _ = table
    got = collections.defaultdict(list)
    for r in maxent.op1_maxent(spark, at).collect():
        got[key(r.doc_id, r.n_tokens)].append(r)
    held = lambda i: i is not None and crc(i, 7) == 2
    c = collections.Counter(w for i, t, *_ in rows if not held(i) for w in [*tokens(t), None])
    n, v = sum(c.values()), len(c)
    assert sum(map(len, got.values())) == len(rows)
    for i, t, *_ in rows:
        w = [*tokens(t), None]
        r = got[key(i, len(w))].pop()
        assert (r.held_out, r.n_known, r.train_tokens) == (held(i), sum(c[x] > 0 for x in w), n)
        assert math.isclose(r.base_score, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9) and math.isfinite(r.score) and r.score < 0


def test_op2(spark, table):
    at, rows, _ = table
    some = [r for r in rows if r[0] != 603]  # the plain version takes every window
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.op2_repeats(spark, at).collect() if r.doc_id != 603), key=repr)
    assert got == brute_repeats(some, 400)


def test_op2_planted_passages(spark, tmp_path):
    """A passage of over 50 words that two documents share is told by its bytes: 399 stay, 400 go; n_bytes is the same either way."""
    rng = random.Random(33)
    word = lambda n: "".join(rng.choice("bcdfglmnprst") for _ in range(n))
    prose = lambda n: " ".join(word(6) for _ in range(n))
    rows, want = [], {}
    for k, size in enumerate((399, 400, 401, 560)):
        passage = " ".join(word(5) for _ in range(size // 6 - 1))
        passage += " " + word(size - len(passage) - 1)
        assert len(passage) == size and len(passage.split()) > 50
        for i, (a, b) in enumerate((("A", "B"), ("C", "D"))):  # capitals part what stands beside the passage
            rows.append((10 * k + i, f"{prose(40)}{a}{passage}{b}{prose(30 + i)}", "en", "s", 0))
            want[10 * k + i] = (size if size >= 400 else 0, int(size >= 400))
    for i in range(100, 108):
        rows.append((i, prose(120), "en", "s", 0))
        want[i] = (0, 0)
    odd(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = repeats.op2_repeats(spark, str(tmp_path)).collect()
    assert {r.doc_id: (r.n_removed, r.n_spans) for r in got} == want
    assert {r.doc_id: r.n_bytes for r in got} == {i: len(t.encode()) for i, t, *_ in rows}
    assert sorted((tuple(r) for r in got), key=repr) == brute_repeats(rows, 400)


def test_op4(spark, table, tmp_path):
    import duckdb

    at, rows, _ = table
    some = [r for r in rows if r[0] is not None and r[0] != 5] + [(5, ODD[4][1], "en", "b", 0)]  # the SQL joins by doc_id
    odd(spark, some).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(JACCARD_SQL)
    assert sorted(tuple(r) for r in op4_jaccard(spark, str(tmp_path)).select(*want.columns).collect()) == sorted(want.fetchall())


def test_op5(spark, table):
    at, rows, _ = table
    got = sharding.op5_sharding(spark, at).collect()
    size = lambda t: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted((str(i), *size(t)) for i, t, *_ in rows)
    by = collections.defaultdict(list)
    for r in got:
        assert r.law == "rows" and r.grown_shard is None
        by[r["shard"]].append(r.slot)
    assert set(by) == set(range(16)) and all(sorted(x) == list(range(len(x))) for x in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    nulls = spark.createDataFrame([(None, f"text {i}", "s") for i in range(640)], "doc_id long, text string, source string")
    spread = sharding.stratified_shards(nulls, 16).withColumn("b", F.shiftrightunsigned(F.xxhash64(F.lit(5), "text"), 60))
    assert spread.groupBy("shard").count().filter("count <> 40").count() == 0


def test_op8(spark, table):
    at, rows, _ = table
    got = collections.defaultdict(list)
    for r in media.op8_media(spark, at).collect():
        got[key(r.doc_id, r.n_bytes)].append(r)
    features = {}
    for i, t, *_ in rows:
        b = (t or "").encode()
        payload = b.ljust(max(1, -(-len(b) // 192)) * 192, b" ")
        r = got[key(i, len(b))].pop()
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        stored = media.text_to_media(b)
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        x = np.frombuffer(payload, np.uint8).reshape(-1, 64, 3).mean(2)
        assert len(r.feature) == 16 and features.setdefault(t or "", r.feature) == r.feature
        if x.shape[0] % 8 == 0:  # an independent resize where rows divide evenly
            wide = np.repeat(x, 9, axis=1).reshape(8, -1, 9, 64).mean((1, 3))
            assert np.allclose(media.area_resize(x, 8, 9), wide)


def test_op9(spark, table):
    at, rows, label = table
    got = toxicity.op9_toxicity(spark, at).collect()
    assert len(got) == len(rows)
    held = lambda i: i is not None and crc(i, 5) == 0
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    judged = [(r.predicted, label[r.doc_id]) for r in got if r.held_out and r.doc_id in label]
    assert sum(p for p, y in judged if y) >= 0.9 * sum(y for _, y in judged) and sum(p for p, y in judged if not y) <= 0.03 * len(judged)
    same = collections.defaultdict(set)
    texts = {i: t for i, t, *_ in rows if i is not None}
    for r in got:
        if r.doc_id is not None and r.doc_id != 5:
            same[texts[r.doc_id] or ""].add(r.score)
    assert all(len(x) == 1 for x in same.values())


def plain_score(model, text):
    """A text's score word by word, with sums in plain Python."""
    values = []
    for w in tokens(text):
        b = np.frombuffer(w.encode(), np.uint8)
        rows, k = toxicity.word_rows(b, np.array([0]), np.array([len(b)]))
        assert len(rows) == k[0] == sum(max(0, len(b) + 3 - n) for n in toxicity.NGRAMS) + 1
        values.append(sum(float(model.weight[r]) for r in rows) / len(rows) + model.bias)
    high = sorted(values, reverse=True)
    x = [high[0] if high else model.bias, high[1] if len(high) > 1 else model.bias, sum(values) / len(values) if values else model.bias, math.log1p(len(values))]
    return 1 / (1 + math.exp(-(model.offset + sum(a * b for a, b in zip(model.slopes, x, strict=True)))))


def test_toxicity_scores_are_plain(spark, table):
    at, rows, label = table
    df = spark.read.parquet(f"{at}/documents.parquet")
    model = toxicity.fit(df, spark.read.parquet(f"{at}/labels.parquet"))
    got = {r.doc_id: r.score for r in toxicity.score(df, model).collect()}
    for i, t, *_ in rows:
        if i is not None and i not in (5, 603):
            assert math.isclose(got[i], plain_score(model, t), rel_tol=1e-3, abs_tol=1e-4)


def test_op10(spark, table):
    at, rows, _ = table
    got = mixing.op10_mixing(spark, at).collect()
    again = mixing.op10_mixing(spark, at).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again)) and len(got) == len(rows)
    size = collections.Counter()
    for i, t, _, s, _ in rows:
        size[s] += len(tokens(t))
    source = {i: s for i, _, _, s, _ in rows}
    taken = collections.Counter()
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == size[s] and 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    goal = {source[r.doc_id]: r.target for r in got}
    assert math.isclose(sum(goal.values()), sum(size.values()), rel_tol=1e-9) and all(abs(taken[s] - goal[s]) <= 1 for s in goal)


def test_a_part_keeps_its_spacing(spark):
    rows = [(i, f"  a{i}\n\tb{i}   c{i} d{i} ", "en", "s" if i % 4 else "t", 0) for i in range(40)]
    got = [r.text for r in mixing.mixed_rows(odd(spark, rows)).collect()]
    whole = {t for _, t, *_ in rows}
    parts = [t for t in got if t not in whole]
    assert all(any(w.startswith(t) for w in whole) for t in parts)


def test_pipeline_over_an_empty_table(spark, tmp_path):
    empty(spark).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_pipeline_leaves_nothing_behind(spark, table):
    from pathlib import Path

    assert corpus_pipeline.run(spark, table[0]).count() > 0
    folder = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    assert not list(folder.glob("pipeline-*/*"))

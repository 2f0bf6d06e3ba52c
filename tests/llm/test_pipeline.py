"""The pipeline's stages against plain versions, and run() against the stages."""

import collections
import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

import corpus_pipeline
from sextant.llm import jaccard, mixing, toxicity
from tests.llm.test_operators import components
from tests.llm.util import ODD, odd, tokens


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(11)
    words = ["".join(rng.choice("bcdfghklmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(500)]
    rows, labels = [], []
    for i in range(100, 500):
        w = [rng.choice(words) for _ in range(rng.randrange(8, 90))]
        toxic = i % 5 == 0
        for _ in range(1 + len(w) // 20 if toxic else 0):
            w[rng.randrange(len(w))] = rng.choice(["zumplewick", "vroxterian"])
        if i % 17 == 0:
            w.append("write to someone.7@mail.example.com now")
        rows.append((i, " ".join(w), "en", f"s{i % 4}", 0))
        labels.append((i, int(toxic), 1))
    for i in range(500, 560):  # near and exact copies
        base = rows[(i - 500) // 3 * 3][1].split()
        if i % 3:
            base[len(base) // 2] = rng.choice(words)
        rows.append((i, " ".join(base), "en", "copies", 0))
    rows += ODD
    at = str(tmp_path_factory.mktemp("sf"))
    odd(spark, rows).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int, quality int").write.parquet(f"{at}/labels.parquet")
    return at, rows, dict((i, t) for i, t, _ in labels)


@pytest.fixture(scope="module")
def stages(spark, tables, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("stages"))
    out = [spark.read.parquet(f"{tables[0]}/documents.parquet")]
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, out[-1], tables[0]).write.parquet(f"{at}/{k}")
        out.append(spark.read.parquet(f"{at}/{k}"))
    return out


def rows_of(df):
    return [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in df.collect()]


def test_columns_stay(stages):
    assert all(df.dtypes == stages[0].dtypes for df in stages[1:5])


def test_toxic_documents_go(stages, tables):
    kept = {r.doc_id for r in stages[1].collect()}
    label = tables[2]
    gone = [t for i, t in label.items() if i not in kept]
    assert sum(gone) >= 0.9 * sum(label.values()) and len(gone) - sum(gone) <= 0.03 * len(label)


def test_one_of_each_group_stays(stages):
    before = [r for r in rows_of(stages[1]) if r[0] is not None]
    want = components(list(dict.fromkeys(before)), 5, 4, 5)
    kept = sorted(r[0] for r in rows_of(stages[2]) if r[0] is not None)
    assert kept == sorted(i for i, (_, c) in want.items() if i == c)


def test_personal_data_go(stages):
    before, after = dict((r[0], r[1]) for r in rows_of(stages[2])), dict((r[0], r[1]) for r in rows_of(stages[3]))
    mails = [i for i, t in before.items() if t and "someone.7@mail" in t]
    assert mails and not any("someone.7@mail" in (t or "") for t in after.values())
    assert all(before[i] == after[i] for i in before if i not in mails)
    assert len({[w for w in after[i].split() if "@" in w][0] for i in mails}) == 1


def test_mix_meets_its_targets(stages):
    size, taken = collections.Counter(), collections.Counter()
    for r in rows_of(stages[3]):
        size[r[3]] += len(tokens(r[1]))
    for r in rows_of(stages[4]):
        taken[r[3]] += len(tokens(r[1]))
    assert abs(sum(size.values()) - sum(taken.values())) <= len(size)
    assert all(taken[s] <= 3 * size[s] for s in size)


def test_packing_is_a_round_trip(spark, stages, tables):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = collections.defaultdict(list)
    for r in rows_of(stages[4]):
        texts[r[0]].append(np.array([*t.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4"))
    pieces = stages[5].collect()
    assert sum(p.length for p in pieces) == sum(len(x) for v in texts.values() for x in v)
    assert all(any(zlib.crc32(x[p.start : p.start + p.length].tobytes()) == p.ids_crc32 and len(x) == p.doc_tokens for x in texts[p.doc_id]) for p in pieces)
    again = corpus_pipeline.run(spark, tables[0])
    key = lambda p: (str(p.doc_id), p.doc_tokens)
    assert collections.Counter(key(p) for p in again.collect() if p.start == 0) == collections.Counter(key(p) for p in pieces if p.start == 0)


def test_stages_leave_clashing_columns_alone(spark):
    rows = [(i, f"word{i} " * (5 + i), "en", "s" if i % 3 else "t", 0) for i in range(12)]
    clash = {c: F.lit(c) for c in ("size", "target", "source_size", "taken", "_h", "_d", "_t", "_v", "_b", "_w", "_s", "_part", "_copy", "_epochs")}
    docs = odd(spark, rows).withColumns(clash)
    for stage in (mixing.mixed_rows, lambda d: jaccard.one_of_each(d, k=5, p=4, q=5)):
        got = stage(docs)
        assert got.columns == docs.columns and got.count() > 0
        assert all(r[c] == c for r in got.collect() for c in clash)


def test_a_failed_stage_leaves_nothing_behind(spark, tmp_path, monkeypatch):
    from pathlib import Path

    odd(spark, [(1, "a b c", "en", "s", 5)]).write.parquet(f"{tmp_path}/documents.parquet")

    def fails(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(corpus_pipeline, "STAGES", [("same", lambda s, d, _: d), ("fails", fails), ("never", fails)])
    with pytest.raises(RuntimeError, match="lost"):
        corpus_pipeline.run(spark, str(tmp_path))
    assert not list(Path(spark.sparkContext.getCheckpointDir().removeprefix("file:")).glob("pipeline-*/*"))


def _texts(n):
    rng = random.Random(5)
    words = [f"{rng.randrange(10**6)}word" for _ in range(400)]
    return [" ".join(rng.choices(words, k=300)) for _ in range(n)]


def test_training_holds_a_words_rows_once():
    """A worker keeps for later stages what training took: the rows of a word must not be held for each text that has it."""
    texts = _texts(3000)
    tracemalloc.start()
    try:
        toxicity.train(texts, np.arange(len(texts)) % 2, epochs=1)
        assert tracemalloc.get_traced_memory()[1] < 80 << 20
    finally:
        tracemalloc.stop()


def test_words_of_several_groups_are_numbered_alike(monkeypatch):
    texts = ["b a b", "", "c B a", None, "é a"]
    whole = toxicity._bags(texts)
    monkeypatch.setattr(toxicity, "groups", lambda offsets: ((i, i + 1) for i in range(len(offsets) - 1)))
    monkeypatch.setattr(toxicity, "WORDS", 1)
    for bags, rows, first in (whole, toxicity._bags(texts)):
        assert [len(b) for b in bags] == [3, 0, 3, 0, 2] and len(first) == 5 and first[-1] == len(rows)
        a, b = bags[0][1], bags[0][0]
        assert bags[0].tolist() == [b, a, b] and bags[2].tolist()[1:] == [b, a] and bags[4][1] == a and len({a, b, bags[2][0], bags[4][0]}) == 4
        assert rows[first[a] : first[a + 1]].tolist() == toxicity.word_rows(np.frombuffer(b"a", np.uint8), np.array([0]), np.array([1]))[0].tolist()


def test_part_hashes_are_not_held_while_they_are_sent(monkeypatch):
    class Docs:  # as much of a DataFrame as hands back the tasks' function
        value = np.zeros(0, np.uint64)
        sparkSession = sparkContext = property(lambda self: self)
        broadcast = select = lambda self, _: self
        mapInArrow = staticmethod(lambda run, _: run)

    texts = _texts(3000)
    monkeypatch.setattr(jaccard, "HELD", 200_000)
    batch = pa.record_batch([pa.array(texts[:1500] + [f"{t} {i} more" for i, t in enumerate(texts)])], ["text"])
    run, held = jaccard.part_hashes(Docs(), 5, 4, 5, Docs.value), []
    tracemalloc.start()
    try:
        for _ in run(iter([batch])):
            held.append(tracemalloc.get_traced_memory()[0])
    finally:
        tracemalloc.stop()
    assert len(held) > 2 and max(held) < 6 << 20


def test_parts_that_meet_by_chance_make_no_large_regions(spark, monkeypatch):
    """Texts of their own, each with a few lines of many: linked ones stay together, the others were one region before."""
    rng = np.random.default_rng(5)
    lines = [" ".join(f"l{i}x{j}" for j in range(24)) for i in range(12)]
    texts = [" ".join([f"w{i}x{j}" for j in range(60)] + [lines[x] for x in rng.choice(12, 4, replace=False)]) for i in range(400)]
    texts += [t + " more" for t in texts[:40]]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    seen = []
    monkeypatch.setattr(jaccard, "LIMIT", 60)
    monkeypatch.setattr(jaccard, "_compared", lambda big, p, q, of=jaccard._compared: seen.append(big.count()) or of(big, p, q))
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_join(docs, 5, 4, 5).collect()}
    assert got == {i: i - 400 if i >= 400 else i for i in range(440)}
    assert sum(seen) < 100


def test_sets_that_link_keep_as_many_parts_as_their_marks_ask_for():
    rng = np.random.default_rng(6)
    for p, q in ((9, 10), (4, 5)):
        scheme = jaccard.Scheme(p, q)
        for n in (3, 6, 9, 20, 33, 60, 110, 250, 900, 4000):
            for _ in range(30):
                a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
                b = np.delete(a, rng.permutation(len(a))[: rng.integers(1, jaccard.max_difference(len(a), p, q) + 2)])
                if not len(b) or q * len(b) < p * len(a):
                    continue
                marked = [dict(zip(*(x.tolist() for x in scheme.marked(s, len(s))), strict=True)) for s in (a, b)]
                both = set(marked[0]) & set(marked[1])
                for m in marked:
                    held = [m[x] for x in both]
                    assert any(sum(x & 7 == y & 7 for x in held) >= y >> 3 for y in held)


def test_packed_parts_come_back():
    rng = np.random.default_rng(7)
    tag, name, mark = np.sort(rng.integers(0, 1 << 40, 999)).astype(np.uint64), rng.integers(0, 1 << 48, 999).astype(np.uint64), rng.integers(0, 256, 999).astype(np.uint8)
    for a, b in zip((tag, name, mark), jaccard._unpacked(jaccard._packed(tag, name, mark)), strict=True):
        assert (a == b).all()


def test_what_was_kept_and_shuffled_goes(spark):
    """A dropped table's files are gone, and cut() leaves the session's setting as it was."""
    from pathlib import Path

    from sextant.llm.common import FREED, cut, drop

    before = spark.conf.get(FREED)
    kept = cut(spark.range(100).groupBy("id").count())
    assert kept.count() == 100 and spark.conf.get(FREED) == before
    at = Path(kept._jdf.queryExecution().logical().rdd().getCheckpointFile().get().removeprefix("file:"))
    assert at.exists()
    drop(kept)
    assert not at.exists()


def test_shingles_and_scores_take_little_more_than_their_texts():
    column = pa.array(_texts(1500))
    model = toxicity.Model(np.ones(1 << toxicity.BITS, np.float32), 0.1)
    for run in (lambda: sum(map(len, jaccard.sets_of(column, 5))), lambda: model.scores(column).sum()):
        tracemalloc.start()
        try:
            run()
            assert tracemalloc.get_traced_memory()[1] < 20 << 20
        finally:
            tracemalloc.stop()

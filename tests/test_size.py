"""What operators send through shuffles and how often they read their input: it grows with the input, not with pairs, and each text is read once."""

import numpy as np
from pyspark.sql import functions as F

from sextant.operators import bridge, code, docs, hygiene


def _written(spark) -> dict[tuple[int, int], tuple[int, int]]:
    """By stage and attempt: the records and bytes that it wrote to a shuffle."""
    sc = spark.sparkContext
    none = sc._jvm.java.util.ArrayList()
    seen = sc._jsc.sc().statusStore().stageList(none, False, False, sc._gateway.new_array(sc._gateway.jvm.double, 0), none)
    return {(s.stageId(), s.attemptId()): (s.shuffleWriteRecords(), s.shuffleWriteBytes()) for s in (seen.apply(i) for i in range(seen.size()))}


def written(spark, make) -> tuple[int, int, list]:
    before = _written(spark)
    rows = make().collect()
    new = [v for k, v in _written(spark).items() if k not in before]
    return sum(v[0] for v in new), sum(v[1] for v in new), rows


def test_similar_sections_dont_expand_copies_or_carry_sets_by_pair(spark):
    rng = np.random.default_rng(5)
    words = [f"word{i}" for i in range(3000)]
    alone = [(f"a{i:03}", "", " ".join(rng.choice(words, 900, replace=False))) for i in range(150)]  # all too far apart, and all share rare words
    same = [(f"c{i:03}", "", "one and the same text") for i in range(600)]
    near = [("n1", "", "one and the same text again"), ("n2", "", "nothing like that")]
    df = spark.createDataFrame(alone + same + near, "chunk_id string, heading string, content string")
    records, _, rows = written(spark, lambda: hygiene.similar_sections(df, least=0.5))
    got = {r.chunk_id: (r.near, r.similarity) for r in rows}
    assert got == {k: ("c598" if k == "c599" else "c599", 1.0) for k, _, _ in same} | {"n1": ("c599", 5 / 6)}
    assert records < 250_000  # 600 copies are 179,700 pairs, which met several times; the documents have 137,619 words


def test_similar_sections_of_some_among_copies(spark):
    df = spark.createDataFrame([("a", "", "red green blue"), ("b", "", "red green blue"), ("c", "", "red green blue black"), ("d", "", "white")], "chunk_id string, heading string, content string")
    got = {r.chunk_id: (r.near, r.similarity) for r in hygiene.similar_sections(df, only=df.filter("chunk_id in ('a', 'c')")).collect()}
    assert got == {"a": ("b", 1.0), "c": ("b", 0.75)}


def test_gaps_read_each_text_once(spark):
    df = spark.createDataFrame([(f"a/f{i}.md", f"Uses `Engine{chr(97 + i % 7)}` and `core{i}.py`, again `core{i}.py`") for i in range(60)], "file_path string, content string")
    reads = lambda out: out._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(content")
    asked = hygiene.gap_candidates(docs.gaps(df)).select("entity", "count", "signal", "importance")
    assert reads(asked) == 5  # a time for each pattern
    assert "collect_list" not in asked._jdf.queryExecution().optimizedPlan().toString()
    by = {r.entity: (r["count"], r.sources) for r in docs.gaps(df).collect()}
    assert by["core3"] == (1, "f3") and by["enginea"] == (9, ", ".join(sorted(f"f{i}" for i in range(0, 60, 7)))) and len(by) == 67
    named = docs.entity_rows(df)
    assert {r.entity: r.sources for r in docs.entity_table(named, df, sample=2).collect()}["enginea"] == "f0, f14"


def test_drift_reads_each_text_once(spark):
    texts = ["`Lost.Thing` in a.fs, b.fs, `Lost.Thing` and b.fs", "Known.Thing, Lost.Method, Other.Known, lib.Known.Deep and c.java", "Core.fs and Core.Missing", "Gone.java, Gone.java"]
    notes = spark.createDataFrame([(f"n{i}", f"notes/{i}.md", "Notes", t) for i, t in enumerate(texts)], "chunk_id string, file_path string, heading string, content string")
    code = spark.createDataFrame([("x/a.fs", "Known"), ("x/core.fs", "Method"), ("y/b2.fs", "ab")], "file_path string, name string")
    out = bridge.drift(notes, code)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(content") == 3  # files, and members under their modules and by themselves
    got = {r.file_path: (r.missing_symbols, r["count"]) for r in out.collect()}
    assert got == {"notes/0.md": ("b.fs, Lost.Thing", 2), "notes/1.md": ("c.java", 1), "notes/3.md": ("Gone.java", 1)}


def test_code_walk_shuffles_no_words(spark):
    rows = [(f"k{i}", i, f"name{i}", f"f{i}.py", 1, " ".join(f"w{i}x{j}" for j in range(200)) + (" start" if i in (3, 5) else "") + (" name3" if i == 9 else "") + ("\ncalls Some.Thing here" if i == 11 else "")) for i in range(100)]
    chunks = spark.createDataFrame(rows, "chunk_id string, ord long, name string, file_path string, start_line int, content string")
    records, _, got = written(spark, lambda: code.walk(chunks, "start", 2, 3))
    assert [(r.hop, r.name, r.match_line.split(" ")[-1]) for r in sorted(got, key=lambda r: r.at)] == [(1, "name3", "start"), (2, "name9", "name3"), (1, "name5", "start")]
    assert records < 2000  # there are 20,000 words
    assert [(r.name, r.match_line) for r in code.walk(chunks, "Some.Thing", 1, 3).collect()] == [("name11", "calls Some.Thing here")]


def test_live_status_looks_for_its_owner_once(spark):
    d = [(f"a/{'status/' if i == 3 else ''}f{i}.md", f"f{i}", [], i % 3, "Current status\ntests baseline delivered", "H") for i in range(9)]
    docs_ = hygiene.with_roles(spark.createDataFrame(d, "file_path string, title string, tags array<string>, backlinks int, text string, primary string"))
    s = docs_.select("file_path", F.lit("H").alias("heading_path"), F.lit("Current status").alias("heading"), F.lit("tests baseline delivered").alias("content"), F.lit(1).alias("level"), F.lit(1).alias("start_line"), F.lit(1).alias("ord"))
    status = hygiene.status_sections(s)
    out = hygiene.live_status(docs_, status, hygiene.status_owner(docs_, status), spark.createDataFrame([], "source_file string, target_resolved string"))
    assert "Limit" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.canonical_owner_candidate, r.confidence) for r in out.filter("finding_type = 'live_status_triage'").collect()} == {("a/status/f3.md", 1.0)} and out.count() == 9


def test_similar_sections_meet_only_those_asked_for(spark):
    rng = np.random.default_rng(7)
    words = [f"tok{i}" for i in range(60)]
    rows = [(f"s{i:03}", "", " ".join(rng.choice(words, rng.integers(5, 25)))) for i in range(120)] + [(f"t{i}", "", "tok1 tok2 tok3 tok4") for i in range(3)]
    df = spark.createDataFrame(rows, "chunk_id string, heading string, content string")
    asked = [r[0] for r in rows[::11]] + ["t0", "t2"]
    got = {r.chunk_id: (r.near, round(r.similarity, 9)) for r in hygiene.similar_sections(df, least=0.12, only=df.filter(F.col("chunk_id").isin(asked))).collect()}
    sets = {k: set(t.split()) for k, _, t in rows}
    best = {a: max((round(len(sets[a] & x) / len(sets[a] | x), 9), b) for b, x in sets.items() if b != a) for a in asked}
    assert got == {a: (b, s) for a, (s, b) in best.items() if s >= 0.12}


def test_similar_sections_meet_in_passes(spark, monkeypatch):
    """Rare tokens are shuffled a bounded number at a time, with the same result."""
    import random

    from sextant.operators import hygiene

    rng = random.Random(8)
    texts = [[f"word{rng.randrange(300)}" for _ in range(40)] for _ in range(40)]
    texts += [[*t[:36], f"other{i}"] for i, t in enumerate(texts[:20])]
    df = spark.createDataFrame([(f"c{i}", " ".join(t), "h") for i, t in enumerate(texts)], "chunk_id string, content string, heading string")
    asked = df.filter("chunk_id < 'c3'").select("chunk_id")
    whole = [sorted(hygiene.similar_sections(df, least=0.3, only=x).collect()) for x in (None, asked)]
    monkeypatch.setattr(hygiene, "PASS", 700)
    assert [sorted(hygiene.similar_sections(df, least=0.3, only=x).collect()) for x in (None, asked)] == whole and len(whole[0]) >= 40

"""Containment, imports, walks and coverage against plain versions, and the cases that a rule's other side decides."""

import random
import re

from pyspark.sql import functions as F

from sextant.operators import bridge, code, contain, docs

CHUNK = "ord long, chunk_id string, file_path string, module string, name string, kind string, start_line int, end_line int, content string"


def chunk_table(spark, rows):
    """rows: (file, name, content)"""
    return spark.createDataFrame([(i, f"c{i}", f, "m", n, "let", i + 1, i + 3, t) for i, (f, n, t) in enumerate(rows)], CHUNK)


def test_held_is_containment(spark):
    dice = random.Random(1)
    word = lambda n: "".join(dice.choices("abé-.", k=n))
    texts, parts = [word(dice.randint(0, 12)) for _ in range(150)], [word(dice.randint(1, 5)) for _ in range(80)]
    got = contain.held(spark.createDataFrame([(t,) for t in texts] + [(None,)], "text string"), spark.createDataFrame([(p,) for p in parts], "part string"))
    assert {tuple(r) for r in got.collect()} == {(t, p) for t in texts for p in parts if len(p) >= 3 and p in t} and got.count() == len(got.distinct().collect())


def test_standing_is_a_match_between_word_borders(spark):
    texts = ["the chunker-core splits it", "chunkercore", "a.b.c and x_y", "über-file.fs (see f(x) or g+h)", "core chunker", None, "", "naïve"]
    names = ["chunker-core", "chunker", "hunker-core", "a.b", "b.c", "b.d", "x_y", "x", "über-file", "file.fs", "le.fs", "f(x", "g+h", "core chunker", "core-chunker", "naïve", "na", "splits it"]
    got = contain.standing(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(t,) for t in texts], "content string"))
    assert {r.name for r in got.collect()} == {n for n in names if any(re.search(rf"\b{re.escape(n)}\b", t or "") for t in texts)}


FILES = [
    ("src/main.rs", "main", "delivery"), ("src/broker/delivery.rs", "DeliveryEngine", "x"), ("js/chunker-core.js", "split", "x"), ("js/index.js", "run", "x"), ("js/other/index.js", "go", "x"),
    ("lib/ab.py", "ab", "x"), ("lib/lone.py", "lone", "x"), ("js/main.js", "start", "x"),
]
IMPORTS = [("src/main.rs", "crate::broker::delivery::DeliveryEngine"), ("js/index.js", "./chunker-core.js"), ("js/other/index.js", "../Chunker-Core"), ("js/index.js", "./chunker-core.js"), ("js/chunker-core.js", "./chunker-core.js"), ("lib/lone.py", "ab"), ("js/main.js", "./index.js"), ("src/main.rs", "std::io")]


def test_imports_are_matched_anywhere_in_a_module(spark):
    chunks, imports = chunk_table(spark, FILES), spark.createDataFrame(IMPORTS, "file_path string, module string")
    edges = {tuple(r) for r in code.import_edges(chunks, imports).collect()}
    assert edges == {("main.rs", "delivery.rs"), ("index.js", "chunker-core.js"), ("main.js", "index.js")}
    fan = {r.file: r.fan_in for r in code.fan_in(chunks, imports).collect()}
    assert fan == {"delivery.rs": 1, "chunker-core.js": 3, "index.js": 1}  # not ab.py (two letters), nor a file's own import
    assert {r.file: r.fan_in for r in code.fan_in(chunks, imports, compat=True).collect()}["chunker-core.js"] == 5
    hot = {r.file_path: (r.fan_in, r.fan_out) for r in code.hotspots(chunks, imports, "fan_in").collect()}
    assert hot["js/chunker-core.js"] == (3, 1) and hot["src/main.rs"] == (0, 2) and hot["js/other/index.js"] == (1, 1)
    assert code.hotspots(chunks, imports, "fan_in", least=2).count() == 0  # the least number of chunks, whatever it is sorted by
    way = code.trace(chunks, imports, "main.js", "chunk").orderBy("step").collect()
    assert [r.node for r in way] == ["main.js", "index.js", "chunker-core.js"] and way[0].length == 2
    assert code.trace(chunks, imports, "main", "delivery").count() == 2
    assert code.trace(chunks, imports, "main.js", "lone").first().error == "no path from 'main.js' to 'lone.py'"


def test_coverage_of_names_with_hyphens(spark):
    chunks, imports = chunk_table(spark, FILES), spark.createDataFrame(IMPORTS, "file_path string, module string")
    told = lambda *texts: [r.file_path for r in bridge.coverage(chunks, imports, spark.createDataFrame([(t,) for t in texts], "content string"), 1).collect()]
    assert told("nothing") == ["js/chunker-core.js", "js/index.js", "src/broker/delivery.rs"]
    assert told("the Chunker-Core splits it", "index.jsx") == ["js/index.js", "src/broker/delivery.rs"] or told("the Chunker-Core splits it") == ["js/index.js", "src/broker/delivery.rs"]
    assert told("chunker_core and chunker core", "DELIVERY!", "the index.") == ["js/chunker-core.js"]


def plain_walk(rows, name, depth, limit):
    seen, out = set(), []

    def go(word, hop, trail):
        if hop > depth or word in seen or len(out) >= 3 * depth * limit:
            return
        seen.add(word)
        hits = 0
        for i, (f, n, t) in enumerate(rows):
            if hits < limit and len(out) < 3 * depth * limit and n != word and re.search(rf"\b{re.escape(word)}\b", t):
                hits += 1
                here = f"{trail} → {n} ({f.rsplit('/', 1)[-1]}:{i + 1})"
                line = next(x.strip() for x in t.split("\n") if re.search(rf"\b{re.escape(word)}\b", x))
                out.append((hop, n, line, here))
                nxt = n.rsplit(".", 1)[-1]
                if len(nxt) > 2 and "_part" not in nxt:
                    go(nxt, hop + 1, here)

    go(name, 1, name)
    return out


def test_walk_is_the_plain_one(spark):
    dice = random.Random(7)
    names = ["alpha", "beta", "M.gamma", "M.de", "x", "run_part2", "omega", "M.alpha", "zeta", "eta"]
    rows = [(f"src/f{i % 7}.py", dice.choice(names), "\n".join(" ".join(dice.choices([n.rsplit(".", 1)[-1] for n in names] + ["noise", "M.gamma"], k=3)) for _ in range(2))) for i in range(40)]
    chunks = chunk_table(spark, rows)
    for name, depth, limit in (("alpha", 2, 3), ("M.gamma", 3, 2), ("de", 2, 40), ("nothing", 2, 3)):
        got = [(r.hop, r.name, r.match_line, r.trail) for r in code.walk(chunks, name, depth, limit).orderBy("at").collect()]
        assert got == plain_walk(rows, name, depth, limit), name


def plain_doc_walk(edges, start, depth):
    seen, out = set(), []

    def go(f, hop, trail):
        if hop > depth or f in seen or len(out) >= depth * 10:
            return
        seen.add(f)
        for dst, via in [(d, v) for d, v in edges.get(f, []) if d not in seen]:
            here = f"{trail} → {dst.rsplit('/', 1)[-1]} ({via})"
            out.append((hop, f, dst, via, here))
            go(dst, hop + 1, here)

    go(start, 1, start.rsplit("/", 1)[-1])
    return out


def test_document_walk_is_the_plain_one(spark):
    dice = random.Random(3)
    links = sorted({(f"d/a{dice.randint(0, 9)}.md", f"d/a{dice.randint(0, 9)}.md") for _ in range(40)} | {("d/a1.md", f"hub/h{i:03d}.md") for i in range(70)})
    rows = [(a, "h", b, b, f"t{i}", i) for i, (a, b) in enumerate(links)]
    table = spark.createDataFrame(rows, "source_file string, source_heading string, target_path string, target_resolved string, link_text string, line int")
    for direction in ("out", "in"):
        edges = {}
        for a, _, b, _, t, _ in rows:
            src, dst = (a, b) if direction == "out" else (b, a)
            edges.setdefault(src, []).append((dst, t))
        for start, depth in (("d/a1.md", 2), ("d/a3.md", 3), ("d/a0.md", 1), ("none.md", 2)):
            got = sorted(tuple(r) for r in docs.walk(table, start, depth, direction).collect())
            assert got == sorted(plain_doc_walk(edges, start, depth)), (direction, start)


def test_expand_and_neighborhood_of_the_code_index(spark):
    chunks, imports = chunk_table(spark, FILES), spark.createDataFrame(IMPORTS, "file_path string, module string")
    one = code.expand(chunks.drop("content"), chunks.select("chunk_id", "content"), "c2", imports).first()
    assert (one.imports, one.dependents) == (["./chunker-core.js"], ["chunker-core.js", "index.js"])
    assert code.expand(chunks.drop("content"), chunks.limit(0).select("chunk_id", "content"), "c6", imports).select("code", F.size("dependents")).first()[:] == ("(source not loaded)", 0)
    many = chunk_table(spark, [("a.py", f"n{i}", "x") for i in range(20)])
    assert [r.distance for r in code.neighborhood(many, "c9", 9, 9).orderBy("distance").collect()] == list(range(-5, 6))


def test_gaps_come_in_order_with_a_note(spark):
    rows = [(f"d{i}.md", "Names Delivery.Engine" + (" and Broker.Queue" if i < 3 else "") + (" and Some.LongerThing" if i == 0 else "") + (" and Ab.Cd" if i == 1 else "")) for i in range(6)]
    source = spark.createDataFrame(rows, "file_path string, content string")
    assert [(r.entity, r.signal) for r in docs.gaps(source).collect()] == [("delivery.engine", "god-node"), ("broker.queue", "shared"), ("some.longerthing", "isolated"), ("ab.cd", "isolated")]
    assert docs.gaps_note(source).collect() == []
    assert docs.gaps_note(source, scope="Zzz").first().note.startswith("No entities matching scope 'Zzz' found. The index has 4 entities across 6 files.")
    assert docs.gaps_note(source, scope="Broker", signal="isolated").first().note == "Scope 'Broker' matched 1 entities, but none have signal 'isolated'. Found signals: shared. Try gaps({scope: 'Broker'}) without signal filter."
    assert docs.gaps_note(source, min_docs=3, signal="isolated").first().note == "No entities with signal 'isolated' found (minDocs=3). The index has 4 entities across 6 files."
    empty = docs.gaps_note(source.limit(0)).first()
    assert (empty.note, empty.total_entities, empty.total_files) == ("No cross-document entity references found.", 0, 0)


def test_lookups_are_joins_on_equality_of_narrow_rows(spark):
    """Parts that share their runs (p1000001, p1000002, ...) never meet all texts that have the run, and a text isn't copied for each of its words."""
    texts, parts = spark.createDataFrame([("parts.p1000001",), ("parts.p1000002",)], "text string"), spark.createDataFrame([("p1000001",), ("p1000003",)], "part string")
    held = contain.held(texts, parts)
    assert [tuple(r) for r in held.collect()] == [("parts.p1000001", "p1000001")]
    assert "Contains(" not in held._jdf.queryExecution().optimizedPlan().toString()
    names = spark.createDataFrame([("p1.fs",), ("p2.fs",), ("a-b-c.fs",), ("b-c",)], "name string")
    stood = contain.standing(names, spark.createDataFrame([("see `p1.fs`\nnot p2-fs, a-b-d.fs",), ("x a-b-c.fs",)], "content string"))
    assert {r.name for r in stood.collect()} == {"p1.fs", "a-b-c.fs", "b-c"}
    made = [x for x in stood._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Generate explode" in x]
    assert made and not any("content#" in x and "[0]" not in x for x in made), made  # [0]: the text that is exploded isn't kept beside its words


def test_a_hop_over_imports_is_its_edges_both_ways(spark):
    """Without making all edges, which grow with files times the modules that hold their stems."""
    chunks, imports = chunk_table(spark, FILES), spark.createDataFrame(IMPORTS, "file_path string, module string")
    edges = {tuple(r) for r in code.import_edges(chunks, imports).collect()}
    hop = code.import_hop(chunks, imports)
    for files in (["index.js"], ["main.rs", "chunker-core.js"], ["lone.py"]):
        got = {tuple(r) for r in hop(spark.createDataFrame([(f,) for f in files], "src string")).collect()}
        assert got == {e for e in edges | {(b, a) for a, b in edges} if e[0] in files}

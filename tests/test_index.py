"""The index part on small fixtures: extraction, storage, operators, expressions and streams."""

import datetime
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from sextant.functions import text as X
from sextant.functions import vectors as V
from sextant.operators import bridge, code, codefiles, docs, graph, hygiene, markdown, scan
from sextant.plans import expr, index
from sextant.plans import format as fmt
from sextant.plans.storage import Catalog, semantic_state
from sextant.sources import embeddings, files

GUIDE = """---
id: g1
title: "The guide"
tags: alpha, beta; gamma
related:
- src/app/core.py
---
Opening words of the guide, which are long enough.
# One
## Two
Some text about `core.py` and Helper.run here.
```
[not](a.md)
# in a fence
```
[other](other.md) and [[wiki]] and [gone](missing.md) [web](http://x/y.md)
# Three
Last words, short.
"""
FILES = [
    ("docs/guide.md", GUIDE),
    ("docs/other.md", "# Other\nSee [guide](guide.md) and core.\n\nAnother paragraph that is long enough to count.\n"),
    ("docs/wiki.md", "Only an opening, nothing links out of here at all.\n"),
    ("src/app/core.py", "import os\nfrom app.util import helper\n\n\nclass Core:\n    def run(self):\n        return helper()\n\n    def stop(self):\n        return Missing\n\n\ndef main():\n    Core().run()\n"),
    ("src/app/util.py", "def helper():\n    return 1\n"),
    ("src/app/Thing.cs", "using System.Text;\nusing App.Core;\nnamespace App.Things;\npublic class Thing\n{\n    public int Size;\n}\npublic record Pair(int A);\n"),
    ("src/node_modules/x.py", "def hidden():\n    pass\n"),
]


@pytest.fixture(scope="module")
def tree(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name, text in FILES:
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return str(root)


@pytest.fixture(scope="module")
def found(spark, tree):
    return files.read_files(spark, tree).cache()


@pytest.fixture(scope="module")
def config():
    return files.Config.load(None).detect(["src", "docs", "tests"])


def test_discovery(found, config):
    assert {r.file_path for r in found.collect()} == {n for n, _ in FILES}
    assert {r.file_path for r in files.code_files(found, config).collect()} == {"src/app/core.py", "src/app/util.py", "src/app/Thing.cs"}
    assert {r.file_path for r in files.doc_files(found, config).collect()} == {n for n, _ in FILES if n.endswith(".md")}
    assert config.scopes["tests"] == ["tests"] and config.src_dirs == ["src"]
    assert files.Config.load('{"exclude": ["gen"], "odd": 1}').exclude[-1] == "gen"


def test_excludes(spark):
    rows = spark.createDataFrame([("a/bin/x.cs",), ("a/binary/x.cs",), ("gen/a/b.cs",), ("gen/b.cs",), ("q1.cs",)], "p string")
    hit = lambda *r: [x.p for x in rows.filter(files.excluded("p", r)).collect()]
    assert hit("bin") == ["a/bin/x.cs"] and hit("gen/**/b.cs") == ["gen/a/b.cs", "gen/b.cs"] and hit("gen/*.cs") == ["gen/b.cs"] and hit("q?.cs") == ["q1.cs"]


def test_sections_and_links(found, config):
    md = files.doc_files(found, config)
    s = markdown.sections(md)
    guide = {r.heading: r for r in s.filter("file_path = 'docs/guide.md'").collect()}
    assert list(sorted(guide)) == sorted(["The guide", "Two", "in a fence", "Three"])  # One is dropped: a heading follows at once
    assert guide["Two"].heading_path == "The guide > One > Two" or guide["Two"].heading_path == "The guide > Two"
    assert guide["The guide"].level == 0 and guide["Three"].tags == ["alpha", "beta", "gamma"]
    aware = {r.heading: r for r in markdown.sections(md, fence_aware=True).filter("file_path = 'docs/guide.md'").collect()}
    assert "in a fence" not in aware and aware["Two"].out_links == ["other.md", "missing.md", "wiki"]
    links = markdown.links(markdown.sections(md, fence_aware=True), md).collect()
    assert {(r.target_path, r.target_resolved) for r in links if r.source_file == "docs/guide.md"} == {("other.md", "docs/other.md"), ("wiki", "docs/wiki.md"), ("missing.md", None)}
    meta = {r.file_path: r for r in markdown.front_matter(md).collect()}
    assert meta["docs/guide.md"].title == "The guide" and meta["docs/guide.md"].related == ["src/app/core.py"] and set(meta) == {"docs/guide.md"}


def test_code_chunks(found, config):
    src = files.code_files(found, config)
    chunks = {(r.file_path, r.name): r for r in codefiles.source_table(src).collect()}
    assert ("src/app/core.py", "Core") in chunks and chunks[("src/app/core.py", "main")].start_line == 13
    assert chunks[("src/app/Thing.cs", "Thing")].end_line == 7 and chunks[("src/app/Thing.cs", "Pair")].kind == "record"
    imports = {(r.file_path, r.module) for r in codefiles.extract(src, "imports").collect()}
    assert {("src/app/core.py", "app.util"), ("src/app/Thing.cs", "App.Core")} <= imports
    refs = {r.file_path: r.types for r in codefiles.type_refs(src).collect()}
    assert "Missing" in refs["src/app/core.py"]
    sigs = codefiles.signatures(codefiles.source_table(src))
    assert ("Core", "class Core") in {(r.name, r.signature) for r in sigs.collect()}


def test_splitting():
    text = "class Big:\n" + "".join(f"    def m{i}(self):\n        return {i}\n" for i in range(40))
    names = [c[2] for c in codefiles.chunk_file("a.py", text, 300)]
    assert names[0] == "Big" and "Big.m7" in names
    parts = codefiles.capped(("f", "", "long", "let", 1, 1, "def f():\n" + "    x = 1\n" * 200 + "y" * 900, ""), 400)
    assert all(len(p[6]) <= 400 for p in parts) and parts[1][2] == "long_part2" and parts[1][6].startswith("// continued: def f():")
    assert codefiles.chunk_file("bad.py", "def (:\n")[0][3] == "module"
    langs = {"a.go": "package x\nfunc Run() {\n}\ntype T struct {\n}\n", "a.rs": "pub fn run() {\n}\nstruct S;\n", "a.ts": "export class A {\n}\nconst b = 1;\n", "a.fs": "module M.N\nlet f x =\n    x\ntype T = int\n"}
    assert {p: [c[2] for c in codefiles.chunk_file(p, t)] for p, t in langs.items()} == {"a.go": ["Run", "T"], "a.rs": ["run", "S"], "a.ts": ["A", "b"], "a.fs": ["f", "T"]}


def test_build_twice(spark, found, config, tmp_path):
    cat = Catalog(spark, str(tmp_path / "code"))
    assert cat.freshness() == "missing" and cat.table("imports").count() == 0
    provider = embeddings.Hashed(16)
    r = index.build_code_index(cat, found, config, provider)
    assert r["semantic_state"] == "full" and index.exit_code(r["semantic_state"], 0) == 0
    first = {x.chunk_id for x in cat.table("code_chunks").collect()}
    changed = found.filter("file_path <> 'src/app/util.py'").withColumn("content", F.when(F.col("file_path") == "src/app/core.py", "def other():\n    pass\n").otherwise(F.col("content"))).withColumn("sha256", F.sha2("content", 256))
    index.build_code_index(cat, changed, config, provider)
    now = cat.table("code_chunks").collect()
    assert {x.name for x in now} == {"other", "Thing", "Pair"} and first & {x.chunk_id for x in now}
    assert cat.freshness(layout=index.LAYOUT, max_chunk_chars=10).startswith("stale")
    d = Catalog(spark, str(tmp_path / "docs"))
    assert index.build_docs_index(d, found, config, provider)["semantic_state"] == "full"
    assert d.table("doc_links").count() >= 3
    index.append_report(spark, str(tmp_path / "inv"), r)
    index.append_report(spark, str(tmp_path / "inv"), r | {"chunks": r["chunks"] + 2, "completed_at": r["completed_at"] + datetime.timedelta(1)})
    assert index.compare(spark.read.parquet(str(tmp_path / "inv")), ["chunks"]).first().chunks_delta == 2
    assert index.preflight(found, config).first().files == 3


def test_code_operators(spark, found, config):
    src = files.code_files(found, config)
    source = codefiles.source_table(src).withColumn("summary", X.summary_line("content")).withColumn("signature", F.lit("")).cache()
    imports = codefiles.extract(src, "imports").cache()
    assert {(r.src, r.dst) for r in code.import_edges(source, imports).collect()} >= {("core.py", "util.py")}
    assert [(r.node, r.length) for r in code.trace(source, imports, "cor", "UTIL").orderBy("step").collect()] == [("core.py", 1), ("util.py", 1)]
    assert [(r.node, r.length) for r in code.trace(source, imports, "core.py", "core").collect()] == [("core.py", 0)]
    assert code.trace(source, imports, "core", "nowhere").first().error == "could not resolve 'nowhere' to a file"
    assert [r.name for r in code.walk(source, "helper", 2, 5).orderBy("at").collect()][:1] == ["Core"]
    assert {r.call_type for r in code.callers(source, "util.helper").collect()} <= {"local", "qualified"}
    assert code.refs(source, "Core").first().name == "main"
    assert {r.module for r in code.modules(source).collect()} == {"app"}
    hot = {r.file_path: (r.fan_in, r.fan_out) for r in code.hotspots(source, imports).collect()}
    assert hot["src/app/util.py"] == (1, 0)
    one = code.context(source, imports, "util.py").first()
    assert one.dependents == ["core.py"] and one.error is None
    assert code.files(source, imports, "*.cs").count() == 1
    assert [r.module for r in code.imports_of(imports, "Thing.cs").collect()] == ["System.Text", "App.Core"]
    assert {r.file for r in code.dependents_of(imports, "util").collect()} == {"core.py"}
    core = source.filter("name = 'Core'").first().chunk_id
    assert "helper()" in code.expand(source.drop("content"), source, core).first().code
    assert [r.distance for r in scan.neighborhood(source, core).orderBy("distance").collect()] == [0, 1]
    assert {r.source_match for r in scan.explain_match(source, source).collect()} == {"chunk_id"}
    assert code.impact(codefiles.type_refs(src), source, "Missing").count() == 1


def test_docs_and_bridge(spark, found, config):
    md = files.doc_files(found, config)
    source = markdown.sections(md, fence_aware=True).cache()
    links = markdown.links(source, md).cache()
    table = markdown.doc_sections(source)
    meta = markdown.front_matter(md)
    assert docs.orphans(table, links).count() == 0
    assert docs.broken(links).first().target == "missing.md"
    assert {r["from"] for r in docs.backlinks(links, "other.md").collect()} == {"docs/guide.md"}
    assert docs.links_of(links, "other.md").first().to == "docs/guide.md"
    assert {r.path for r in docs.walk(links, "docs/other.md", 2).collect()} == {"docs/guide.md", "docs/wiki.md"}
    assert docs.catalog(table).first().docs == 3
    c = docs.context(table, links, meta, "guide.md").first()
    assert c.title == "The guide" and len(c.backlinks) == 1 and any(x["to"].startswith("⚠") for x in c.outlinks)
    assert docs.files(table, links, meta, "guide").first().backlinks == 1
    code_chunks = codefiles.source_table(files.code_files(found, config)).cache()
    gone = {r.heading: r.missing_symbols for r in bridge.drift(source, code_chunks).collect()}
    assert all("core.py" not in v for v in gone.values())
    imports = codefiles.extract(files.code_files(found, config), "imports")
    assert {r.file_path for r in bridge.coverage(code_chunks, imports, source, 1).collect()} == {"src/app/util.py"}
    roles = {r.file_path: r.role for r in hygiene.with_roles(hygiene.profiles(source, meta, links)).collect()}
    assert set(roles) == {"docs/guide.md", "docs/other.md", "docs/wiki.md"}
    assert index.health(table, links, spark.createDataFrame([], "x int")).filter("what = 'total'").first().n == 1


def test_hygiene_findings(spark):
    status = "The current status: active wave two, tests baseline delivered. Other docs should point here, canonical owner."
    rows = [("docs/current-status.md", status), ("docs/roadmap.md", "Current status: active wave two, tests baseline delivered for the plan."), ("docs/archive/old.md", "Current status was delivered; tests baseline, written at the time."), ("docs/readme.md", "Words without any of it.")]
    s = spark.createDataFrame([(f"c{i}", i, p, "Current status", "Current status", 1, 1, 2, t) for i, (p, t) in enumerate(rows)], "chunk_id string, ord long, file_path string, heading string, heading_path string, level int, start_line int, end_line int, content string")
    links = spark.createDataFrame([("docs/roadmap.md", "Current status", "x", "docs/current-status.md", "x", 1), ("docs/readme.md", "Current status", "x", "docs/current-status.md", "x", 1)], "source_file string, source_heading string, target_path string, target_resolved string, link_text string, line int")
    meta = spark.createDataFrame([], "file_path string, title string, tags array<string>")
    got = hygiene.findings(s, meta, links)
    assert got.columns == list(hygiene.COLUMNS)
    rows = got.collect()
    assert {r.canonical_owner_candidate for r in rows if r.finding_type == "live_status_triage"} == {"docs/current-status.md"}
    assert {r.source_file for r in rows if r.finding_type == "live_status_triage"} >= {"docs/archive/old.md", "docs/roadmap.md"}
    owner = [r for r in rows if r.finding_type == "canonical_owner_candidate"]
    assert len(owner) == 1 and owner[0].source_file == "docs/current-status.md" and owner[0].evidence[0].startswith("Candidate score ")
    assert {r.finding_type for r in rows} >= {"canonical_owner_candidate", "live_status_triage", "orphan_triage"} and all(r.why_flagged for r in rows)
    assert [r.confidence for r in rows] == sorted((r.confidence for r in rows), reverse=True)
    parts = ["canonical_owner_candidate", "live_status_triage", "section_triage", "orphan_triage", "gap_triage"]
    places = [(-r.confidence, parts.index(r.finding_type), r.source_file) for r in rows]
    assert places == sorted(places) and hygiene.findings_note(got, s).collect() == []
    assert hygiene.findings_note(got.limit(0), s).first()[:] == ("No hygiene findings detected for the current index.", 4)


def test_section_triage(spark):
    spec = "file_path string, role string, backlinks int, heading string, heading_path string, level int, content string, similarity double, near_name string, broken_here array<string>, status_score int, has_status boolean, role_evidence array<string>"
    case = lambda role, text, sim=0.0, broken=0, back=1, live=False: (f"{role}-{text}.md", role, back, "H", "H", 1, text, sim, "n", ["x.md"] * broken, 0, live, ["e"])
    rows = [
        case("mixed", "an invariant that we must preserve"), case("mixed", "api json payload", 0.3), case("mixed", "plain words"),
        case("decision_index", "the linked target disagrees in this decision register"), case("decision_index", "register entry, broken link", broken=1),
        case("decision_index", "derived index of choices"), case("decision_index", "a decision register"), case("decision_index", "recorded on 2024-01-02"),
        case("research_note", "finding that contradicts the other"), case("research_note", "hypothesis with an evidence gap"), case("research_note", "setup and migration"),
        case("review_or_decision_record", "rationale of what was accepted"), case("review_or_decision_record", "api json", 0.1),
    ]
    got = {r.source_file: (r.acceptance_scenario_id, r.suggested_action, r.expected_human_action_shape) for r in hygiene.section_triage(spark.createDataFrame(rows, spec)).collect()}
    at = lambda i: got.get(rows[i][0])
    assert at(0) == ("section-preserve-reduce", "preserve", "ignore") and at(1)[2] == "link" and at(2)[1] == "needs_human_review"
    assert at(3)[0] == "decision-index-contradiction" and at(4)[0] == "decision-index-target-missing" and at(4)[2] == "link"
    assert at(5)[0] == "decision-index-derived" and at(6) is None and at(7)[0] == "decision-index-historical-snapshot"
    assert at(8)[0] == "research-note-conflict" and at(9)[0] == "research-note-evidence-gap" and at(10)[2] == "reduce"
    assert at(11)[2] == "accept" and at(12)[2] == "reduce"


def test_similar_sections_are_exact(spark):
    rng = np.random.default_rng(3)
    words = [f"tok{i}" for i in range(40)]
    rows = [(str(i), "", " ".join(rng.choice(words, 12))) for i in range(40)]
    got = {r.chunk_id: round(r.similarity, 9) for r in hygiene.similar_sections(spark.createDataFrame(rows, "chunk_id string, heading string, content string")).collect()}
    sets = {k: set(t.split()) for k, _, t in rows}
    want = {}
    for a, x in sets.items():
        best = max(len(x & y) / len(x | y) for b, y in sets.items() if a != b)
        if best >= 0.15:
            want[a] = round(best, 9)
    assert got == want


def test_gaps_novelty_cluster(spark):
    src = spark.createDataFrame([("a/One.md", "Uses `DeliveryEngine` and System.Text.Json, see `core.py`."), ("b/Two.md", "`DeliveryEngine.cs` again"), ("c/Three.md", "nothing")], "file_path string, content string")
    got = {r.entity: (r["count"], r.signal, r.total_files) for r in docs.gaps(src).collect()}
    assert got["deliveryengine"] == (2, "shared", 3) and got["text"][1] == "isolated"
    assert docs.gaps(src, scope="DeliveryEngine").count() == 1 and docs.gaps(src, signal="god-node").count() == 0
    vec = spark.createDataFrame([("d", "x.md", "H", [1.0, 0.0], 1), ("d", "y.md", "H", [0.9, 0.1], 2), ("d", "z-notes.md", "H", [0.0, 1.0], 3), ("d", "zz.md", "H", [0.1, 1.0], 4)], "directory string, file_path string, heading string, emb array<float>, ord long")
    assert [r.cluster for r in docs.cluster(vec).orderBy("file_path").collect()] == [0, 0, 1, 1]
    assert docs.suggested_folders(docs.cluster(vec)).count() == 2
    p = spark.createDataFrame([("A service must always be started because of x.", [1.0, 0.0])], "paragraph string, emb array<float>")
    assert docs.novelty(p, vec).first().status == "covered"
    assert docs.placement(vec.withColumn("heading_path", F.col("heading")), [1.0, 0.0], 2).first().file_path == "x.md"
    assert [round(r.s, 3) for r in vec.select(V.cosine("emb", F.array(F.lit(0.0), F.lit(0.0))).alias("s")).collect() if r.s is not None] == []
    assert semantic_state(vec, vec, "emb") == "full"


def test_stale(spark):
    t = datetime.datetime(2024, 1, 1)
    times = spark.createDataFrame([("docs/a.md", t), ("src/core.py", t + datetime.timedelta(days=3)), ("src/new.py", t + datetime.timedelta(hours=2))], "file_path string, modified timestamp")
    meta = spark.createDataFrame([("docs/a.md", ["src/new.py"])], "file_path string, related array<string>")
    named = spark.createDataFrame([("docs/a.md", "core.py"), ("docs/a.md", "new.py")], "file_path string, target string")
    assert {r.target_file for r in docs.stale(meta, times, named).collect()} == {"src/core.py", "src/new.py"}


def test_graph(spark):
    e = spark.createDataFrame([("a", "b", 1), ("b", "c", 2), ("c", "d", 3), ("a", "x", 4), ("x", "d", 5)], "src string, dst string, ord long")
    path = lambda a, b: [r.node for r in graph.shortest_path(e, a, b).orderBy("step").collect()]
    assert path("a", "d") == ["a", "x", "d"] and path("a", "zz") == [] and path("a", "a") == ["a"]


def test_shortest_path_is_as_long_as_it_must_be(spark):
    chain = [f"n{k:02d}" for k in range(12)]
    rows = [*zip(chain, chain[1:], strict=False), ("n00", "loop"), ("loop", "n02"), ("n05", "n05"), ("apart", "away")]
    e = spark.createDataFrame(rows, "src string, dst string")
    assert [r.node for r in graph.shortest_path(e, "n00", "n11").orderBy("step").collect()] == ["n00", "loop", *chain[2:]]
    assert graph.shortest_path(e, "n11", "apart").collect() == []

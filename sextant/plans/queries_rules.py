"""Queries of the triage. Each part stands for a document or section out of a short list; what the rules make of it stands in the SQL, literally."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.operators import docs, hygiene
from sextant.plans import standins as S
from sextant.plans.queries import query
from sextant.plans.queries_code import _GAPS
from sextant.plans.storage import cut

#: Folder, text and backlinks of documents; role and confidence that they get.
ROLES = (
    ("a/status/", "plain words", 0, "canonical_live_status_owner", 0.75), ("a/", "the canonical owner of the current status", 3, "canonical_live_status_owner", 0.95), ("a/archive/", "written at the time", 0, "historical_archive", 1.0),
    ("a/spec/", "a json payload", 0, "implemented_spec", 0.95), ("a/design/", "the core idea", 0, "research_deep_dive", 0.95), ("a/research/", "a hypothesis", 0, "research_note", 1.0),
    ("a/decision-index/", "a decision register", 0, "decision_index", 0.9), ("a/roadmap/", "a release note", 0, "product_or_control_plane_doc", 1.0), ("a/readme/", "words", 0, "entrypoint_or_index_doc", 0.75),
    ("a/adr/", "it was accepted", 0, "review_or_decision_record", 0.95), ("a/b/", "nothing here", 0, "unknown", 0.25), ("a/spec/", "core idea of the json", 0, "implemented_spec", 0.8),
    ("a/design/", "json of the core idea", 0, "research_deep_dive", 0.8), ("a/", "a hypothesis in json", 0, "mixed", 0.55),
)

#: Role, text, similarity to the nearest section and broken links of sections; scenario, action, shape, confidence and risk (None: no finding).
SECTIONS = (
    ("mixed", "an invariant that we must preserve", 0.0, 0, ("section-preserve-reduce", "preserve", "ignore", 0.75, "medium")), ("mixed", "api json payload", 0.3, 0, ("section-preserve-reduce", "link", "link", 0.825, "medium")),
    ("mixed", "plain words", 0.0, 0, ("section-preserve-reduce", "needs_human_review", "needs_human_review", 0.45, "high")),
    ("decision_index", "the linked target disagrees in this decision register", 0.0, 0, ("decision-index-contradiction", "needs_human_review", "link", 0.835, "medium")),
    ("decision_index", "register entry, broken link", 0.0, 1, ("decision-index-target-missing", "preserve", "link", 0.747, "medium")), ("decision_index", "derived index of choices", 0.0, 0, ("decision-index-derived", "needs_human_review", "link", 0.563, "low")),
    ("decision_index", "a decision register", 0.0, 0, None), ("decision_index", "recorded on 2024-01-02", 0.0, 0, ("decision-index-historical-snapshot", "needs_human_review", "accept", 0.647, "low")),
    ("research_note", "finding that contradicts the other", 0.0, 0, ("research-note-conflict", "needs_human_review", "link", 0.683, "medium")), ("research_note", "hypothesis with an evidence gap", 0.0, 0, ("research-note-evidence-gap", "preserve", "link", 0.767, "medium")),
    ("research_note", "setup and migration", 0.0, 0, ("research-note-section-preserve-reduce", "needs_human_review", "reduce", 0.5, "medium")),
    ("review_or_decision_record", "rationale of what was accepted", 0.0, 0, ("decision-record-section-preserve-reduce", "needs_human_review", "accept", 0.617, "low")),
    ("review_or_decision_record", "api json", 0.1, 0, ("decision-record-section-preserve-reduce", "needs_human_review", "reduce", 0.642, "medium")),
)

#: Role, text, backlinks, links out, broken ones, artifact ids, nearest document and its similarity; action, shape, confidence and risk (None: no finding).
ORPHANS = (
    ("decision_index", "x", 0, 0, 1, 0, "", 0.0, ("preserve", "link", 0.84, "medium")), ("decision_index", "x", 0, 2, 0, 0, "", 0.0, ("preserve", "ignore", 0.86, "low")), ("decision_index", "add an entry link", 0, 0, 0, 0, "", 0.0, ("preserve", "link", 0.8, "medium")),
    ("entrypoint_or_index_doc", "x", 0, 3, 0, 0, "", 0.0, ("preserve", "ignore", 0.92, "low")), ("historical_archive", "x", 0, 0, 0, 0, "", 0.0, ("preserve", "ignore", 0.82, "low")), ("research_deep_dive", "x", 0, 0, 0, 0, "", 0.0, ("preserve", "link", 0.86, "low")),
    ("review_or_decision_record", "x", 0, 0, 0, 2, "", 0.0, ("preserve", "ignore", 0.85, "low")), ("review_or_decision_record", "x", 0, 1, 0, 1, "", 0.0, ("preserve", "link", 0.8, "medium")), ("research_note", "a missing artifact", 0, 0, 0, 0, "", 0.0, ("preserve", "link", 0.82, "medium")),
    ("research_note", "x", 0, 0, 0, 0, "", 0.0, ("preserve", "link", 0.8, "medium")), ("unknown", "x", 0, 0, 0, 0, "", 0.0, ("needs_human_review", "link", 0.74, "medium")), ("unknown", "x", 0, 1, 0, 0, "b.md", 0.3, ("needs_human_review", "link", 0.72, "medium")), ("unknown", "x", 1, 0, 0, 0, "", 0.0, None),
)


def _quoted(x: object) -> str:
    return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else "NULL" if x is None else str(x)


def _values(rows, columns: str) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(_quoted(x) for x in (i, *r)) + ")" for i, r in enumerate(rows)) + f") v(i, {columns})"


def _case(n: int) -> Column:
    return (F.col("p_partkey") % n).cast("int").alias("i")


def _cases(spark: SparkSession, sf_dir: str, rows, spec: str) -> DataFrame:
    """Each part with its row of a short list (broadcast)."""
    few = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {spec}")
    return S.table(spark, sf_dir, "part").select("p_partkey", _case(len(rows))).join(F.broadcast(few), "i")


def _file(folder: Column) -> Column:
    return F.concat(folder, F.lit("P"), F.col("p_partkey").cast("string"), F.lit(".md"))


@query(f"SELECT folder || 'P' || p_partkey || '.md' AS file_path, role, confidence::DOUBLE AS confidence FROM part JOIN {_values([(r[0], r[3], r[4]) for r in ROLES], 'folder, role, confidence')} ON i = p_partkey % {len(ROLES)}")
def doc_roles(spark, sf_dir):
    d = _cases(spark, sf_dir, [r[:3] for r in ROLES], "folder string, text string, backlinks int")
    none = F.array().cast("array<string>")
    d = d.select(_file(F.col("folder")).alias("file_path"), _name().alias("title"), none.alias("tags"), "backlinks", "text")
    return hygiene.with_roles(d).select("file_path", "role", F.round("role_confidence", 6).alias("confidence"))


def _name() -> Column:
    return F.concat(F.lit("P"), F.col("p_partkey").cast("string"))


@query(f"""SELECT 'P' || p_partkey || '.md' AS source_file, scenario AS acceptance_scenario_id, action AS suggested_action, shape AS expected_human_action_shape, confidence::DOUBLE AS confidence, risk
 FROM part JOIN {_values([r[4] if r[4] else (None,) * 5 for r in SECTIONS], 'scenario, action, shape, confidence, risk')} ON i = p_partkey % {len(SECTIONS)} WHERE scenario IS NOT NULL""")
def section_triage(spark, sf_dir):
    d = _cases(spark, sf_dir, [r[:4] for r in SECTIONS], "role string, content string, similarity double, broken int")
    d = d.select(
        _file(F.lit("")).alias("file_path"), "role", F.lit(1).alias("backlinks"), F.lit("H").alias("heading"), F.lit("H").alias("heading_path"), F.lit(1).alias("level"), "content", "similarity", F.lit("n").alias("near_name"),
        F.array_repeat(F.lit("x.md"), F.col("broken")).alias("broken_here"), F.lit(0).alias("status_score"), F.lit(False).alias("has_status"), F.array(F.lit("e")).alias("role_evidence"),
    )
    return hygiene.section_triage(d).select("source_file", "acceptance_scenario_id", "suggested_action", "expected_human_action_shape", "confidence", "risk")


@query("""SELECT 'd' || doc_id || '.md' AS source_file, 'section_triage' AS finding_type, 'neon-deep-dive-protection' AS acceptance_scenario_id, 'A, Why' AS sections, 'preserve' AS suggested_action, 'ignore' AS expected_human_action_shape, 0.88::DOUBLE AS confidence, 'low' AS risk,
 'Research deep-dive role with 2 preserve-worthy section(s).' AS said FROM documents WHERE lang IN ('en', 'de')""")
def deep_dives(spark, sf_dir):
    """Three sections a document: one with an invariant, one under Why, one that is only scaffolding. Those in French have no links, in Spanish live status."""
    d = S.table(spark, sf_dir, "documents")
    parts = F.explode(F.array(*[F.struct(F.lit(i).alias("start_line"), F.lit(h).alias("heading"), F.lit(c).alias("content")) for i, (h, c) in enumerate((("A", "one invariant of it"), ("Why", "plain reasons"), ("B", "api json payload")))]))
    d = d.select(F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".md")).alias("file_path"), "lang", parts.alias("x")).select("file_path", "lang", "x.*")
    d = d.select(
        "file_path", F.lit("research_deep_dive").alias("role"), F.array(F.lit("e")).alias("role_evidence"), F.when(F.col("lang") == "fr", 0).otherwise(1).alias("backlinks"), (F.col("lang") == "es").alias("has_status"), F.lit(1).alias("level"), F.lit(0).alias("status_score"),
        "start_line", F.lit(1).alias("ord"), "heading", F.col("heading").alias("heading_path"), "content", F.lit(0.1).alias("similarity"), F.lit("n").alias("near_name"),
    )
    return hygiene.deep_dives(d).select("source_file", "finding_type", "acceptance_scenario_id", F.array_join("sections", ", ").alias("sections"), "suggested_action", "expected_human_action_shape", "confidence", "risk", F.get("evidence", F.lit(0)).alias("said"))


@query(f"""SELECT 'P' || p_partkey || '.md' AS source_file, action AS suggested_action, shape AS expected_human_action_shape, confidence::DOUBLE AS confidence, risk, CASE WHEN near = '' THEN 'unknown' ELSE near END AS nearest_owner_or_cluster
 FROM part JOIN {_values([(r[6], *(r[8] or (None,) * 4)) for r in ORPHANS], 'near, action, shape, confidence, risk')} ON i = p_partkey % {len(ORPHANS)} WHERE action IS NOT NULL""")
def orphan_triage(spark, sf_dir):
    d = _cases(spark, sf_dir, [r[:8] for r in ORPHANS], "role string, text string, backlinks int, outlinks long, broken_links long, artifacts int, near string, similarity double").withColumn("file_path", _file(F.lit("")))
    nearest = d.filter("near <> ''").select("file_path", "near", "similarity")
    d = d.select("file_path", _name().alias("title"), "role", F.array(F.lit("e")).alias("role_evidence"), "text", "backlinks", "outlinks", "broken_links", "artifacts", F.lit("H").alias("primary"))
    return hygiene.orphan_triage(d, nearest).select("source_file", "suggested_action", "expected_human_action_shape", "confidence", "risk", "nearest_owner_or_cluster")


@query(f"WITH {_GAPS} SELECT entity, count, signal, importance FROM gaps WHERE signal IN ('isolated', 'god-node') AND importance >= 4 ORDER BY count DESC, importance DESC, entity LIMIT 5")
def gap_candidates(spark, sf_dir):
    return hygiene.gap_candidates(docs.gaps(S.notes(spark, sf_dir))).select("entity", "count", "signal", "importance")


# Live status ---------------------------------------------------------------------


def _status_docs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A document of one section for each part; those of two types state live status, those of the largest size lie in a status folder."""
    p = S.table(spark, sf_dir, "part")
    live, gate = F.col("p_type") == "ECONOMY", F.col("p_type") == "PROMO"
    path = _file(F.when(F.col("p_size") >= 48, "a/status/").otherwise("a/"))
    s = p.select(
        path.alias("file_path"), F.when(live, "Current status").when(gate, "Progress gate").otherwise("Notes").alias("heading"), F.when(live | gate, "tests baseline delivered").otherwise("words").alias("content"), F.lit(1).alias("level"), F.lit(1).alias("start_line"),
        F.col("p_partkey").alias("ord"), F.lit("H").alias("heading_path"), _name().alias("chunk_id"), (F.col("p_size") % 3).alias("backlinks"), _name().alias("title"),
    )
    d = s.select("file_path", "title", F.array().cast("array<string>").alias("tags"), "backlinks", F.concat_ws("\n", "heading", "content").alias("text"), F.col("heading_path").alias("primary"))
    # A small file, but much to do for each row: dealt out, and judged once.
    d = d.repartition(4 * spark.sparkContext.defaultParallelism, "file_path")
    return cut(hygiene.with_roles(d)), s.drop("backlinks", "title")


_STATUS = """d AS (SELECT CASE WHEN p_size >= 48 THEN 'a/status/' ELSE 'a/' END || 'P' || p_partkey || '.md' AS file_path, p_type, p_size >= 48 AS named, p_size % 3 AS b FROM part WHERE p_type IN ('ECONOMY', 'PROMO')),
 r AS (SELECT *, 1 + CASE WHEN named THEN 7 ELSE 0 END + least(2, b) AS score, row_number() OVER (ORDER BY 1 + CASE WHEN named THEN 7 ELSE 0 END + least(2, b) DESC, file_path) AS k FROM d),
 o AS (SELECT file_path, p_type, score, coalesce((SELECT score FROM r WHERE k = 2), 0) AS second FROM r WHERE k = 1),
 owner AS (SELECT *, least(1.0, 0.45 + score / 12 + greatest(0, score - second) / 15)::DOUBLE AS confidence FROM o)"""


@query(f"WITH {_STATUS} SELECT file_path, score::INT AS score, second::INT AS second, round(confidence, 6) AS confidence, CASE WHEN confidence >= 0.85 AND score - second >= 3 THEN 'asserted' ELSE 'candidate' END AS owner_status FROM owner")
def status_owner(spark, sf_dir):
    d, s = _status_docs(spark, sf_dir)
    return hygiene.status_owner(d, hygiene.status_sections(s)).select("file_path", "score", "second", F.round("confidence", 6).alias("confidence"), "owner_status")


@query(f"""WITH {_STATUS}, x AS (SELECT r.file_path, named, r.p_type = owner.p_type AS same FROM r, owner WHERE r.file_path <> owner.file_path)
 SELECT file_path AS source_file, CASE WHEN same THEN 'neon-live-status' ELSE 'neon-live-status-stale' END AS acceptance_scenario_id, CASE WHEN NOT named THEN 'needs_human_review' WHEN same THEN 'link' ELSE 'reduce' END AS suggested_action, CASE WHEN same THEN 'link' ELSE 'reduce' END AS expected_human_action_shape,
 CASE WHEN same THEN 1.0 ELSE 0.873 END::DOUBLE AS confidence, CASE WHEN NOT named THEN 'high' WHEN same THEN 'low' ELSE 'medium' END AS risk, (SELECT file_path FROM owner) AS canonical_owner_candidate FROM x""")
def live_status(spark, sf_dir):
    d, s = _status_docs(spark, sf_dir)
    status = hygiene.status_sections(s)
    links = spark.createDataFrame([], "source_file string, target_resolved string")
    out = hygiene.live_status(d, status, hygiene.status_owner(d, status), links).filter("finding_type = 'live_status_triage'")
    return out.select("source_file", "acceptance_scenario_id", "suggested_action", "expected_human_action_shape", "confidence", "risk", "canonical_owner_candidate")


# The triage as a whole -------------------------------------------------------------

#: Folders, by the length of a document, and what its section says, by its number.
FOLDERS = ("a/b/", "a/spec/", "a/design/", "a/research/", "a/decision-index/", "a/adr/", "a/archive/")
SAYS = ("plain words", "an invariant that we must preserve", "api json payload", "a hypothesis with an evidence gap", "register entry, broken link", "it was accepted", "finding that contradicts the other", "written at the time")


def _triaged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Sections and links: each document is a file of one section with a phrase and forty words of its own; each eleventh states live status instead,
    a few name an entity of their own. Two of three link to the next document, each seventh twice more, each fifth to a file that isn't there."""
    d = S.table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    id_, live = F.col("doc_id").cast("string"), F.col("doc_id") % 11 == 5
    folder = lambda n: F.element_at(F.array(*map(F.lit, FOLDERS)), (n % 7 + 1).cast("int"))
    path = F.concat(folder(F.col("n_chars")), F.lit("d"), id_, F.lit(".md"))
    says = F.when(live, "tests baseline delivered").otherwise(F.element_at(F.array(*map(F.lit, SAYS)), (F.col("doc_id") % 8 + 1).cast("int")))
    own = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(39)), lambda k: F.concat(F.lit("q"), id_, F.lit("z"), k.cast("string"))), " ")
    named = F.when(F.col("doc_id") % 50 == 7, F.concat(F.lit(" `Lonelyentity"), F.translate(id_, "0123456789", "abcdefghij"), F.lit("`"))).otherwise("")
    heading = F.when(live, "Current status").otherwise("Notes")
    s = d.select("doc_id", id_.alias("chunk_id"), F.col("doc_id").alias("ord"), path.alias("file_path"), heading.alias("heading"), heading.alias("heading_path"), F.lit(1).alias("level"), F.lit(1).alias("start_line"), F.lit(2).alias("end_line"), F.concat(says, F.lit(" "), own, named).alias("content"))
    to = s.select((F.col("doc_id") - 1).alias("doc_id"), F.col("file_path").alias("target_resolved"))
    times = F.when(F.col("doc_id") % 3 != 0, 1).otherwise(0) + F.when(F.col("doc_id") % 7 == 0, 2).otherwise(0)
    links = s.join(to, "doc_id").select(F.col("file_path").alias("source_file"), F.col("heading").alias("source_heading"), F.lit("next").alias("target_path"), "target_resolved", F.explode(F.array_repeat(F.lit(1), times)).alias("line"))
    lost = s.filter("doc_id % 5 = 0").select(F.col("file_path").alias("source_file"), F.col("heading").alias("source_heading"), F.lit("gone.md").alias("target_path"), F.lit(None).cast("string").alias("target_resolved"), F.lit(1).alias("line"))
    return s.drop("doc_id"), links.unionByName(lost)


#: In SQL: the points of roles by folder and by phrase, and how many terms of each kind a phrase holds, counted by hand; then the rules. No two files share an eighth of their words.
@query(f"""WITH d AS (SELECT doc_id AS k, (n_chars % 7)::INT AS f, CASE WHEN doc_id % 11 = 5 THEN 8 ELSE (doc_id % 8)::INT END AS g FROM documents),
 folders(f, folder, historical, spec, deep, note, idx, entry, record) AS (VALUES (0, 'a/b/', 0, 0, 0, 0, 0, 0, 0), (1, 'a/spec/', 0, 2, 0, 0, 0, 0, 0), (2, 'a/design/', 0, 0, 2, 0, 0, 0, 0), (3, 'a/research/', 0, 0, 0, 3, 0, 0, 0), (4, 'a/decision-index/', 0, 0, 0, 0, 4, 3, 3), (5, 'a/adr/', 0, 0, 0, 0, 0, 0, 3), (6, 'a/archive/', 4, 0, 0, 0, 0, 0, 0)),
 phrases(g, historical, spec, deep, note, idx, record, u, ge, ix, de, mi, hi, re, co, ga) AS (VALUES (0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0), (1, 0, 0, 3, 0, 0, 0, 3, 0, 0, 0, 0, 0, 0, 0, 0), (2, 0, 3, 0, 0, 0, 0, 0, 3, 0, 0, 0, 0, 0, 0, 0), (3, 0, 0, 0, 3, 0, 0, 0, 0, 0, 0, 0, 0, 2, 0, 1),
  (4, 0, 0, 0, 0, 3, 0, 0, 0, 1, 0, 1, 0, 0, 0, 0), (5, 0, 0, 0, 0, 0, 2, 0, 0, 0, 1, 0, 0, 0, 0, 0), (6, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 1, 1, 0), (7, 2, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 1, 0, 0, 0), (8, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0)),
 o AS (SELECT k, f, g, folder || 'd' || k || '.md' AS file, (CASE WHEN k % 3 <> 0 THEN 1 ELSE 0 END + CASE WHEN k % 7 = 0 THEN 2 ELSE 0 END) * (k + 1 IN (SELECT k FROM d))::INT AS nexts, (k % 5 = 0)::INT AS broken FROM d JOIN folders USING (f)),
 b AS (SELECT o.*, o.nexts + o.broken AS outs, coalesce(p.nexts, 0) AS backs FROM o LEFT JOIN o p ON p.k = o.k - 1),
 points AS (SELECT k, unnest([{{'i': 0, 'role': 'canonical_live_status_owner', 'n': CASE WHEN g = 8 THEN least(2, backs) ELSE 0 END}}, {{'i': 1, 'role': 'historical_archive', 'n': x.historical + y.historical}}, {{'i': 2, 'role': 'implemented_spec', 'n': x.spec + y.spec}}, {{'i': 3, 'role': 'research_deep_dive', 'n': x.deep + y.deep}},
  {{'i': 4, 'role': 'research_note', 'n': x.note + y.note}}, {{'i': 5, 'role': 'decision_index', 'n': x.idx + y.idx}}, {{'i': 7, 'role': 'entrypoint_or_index_doc', 'n': x.entry}}, {{'i': 8, 'role': 'review_or_decision_record', 'n': x.record + y.record}}]) AS s FROM b JOIN folders x USING (f) JOIN phrases y USING (g)),
 ranked AS (SELECT k, s.role AS role, s.n AS n, row_number() OVER (PARTITION BY k ORDER BY s.n DESC, s.i) AS nth FROM points),
 roles AS (SELECT k, CASE WHEN max(n) < 3 THEN 'unknown' WHEN max(n) FILTER (WHERE nth = 2) >= greatest(3, max(n) - 1) THEN 'mixed' ELSE max(role) FILTER (WHERE nth = 1) END AS role FROM ranked GROUP BY k),
 p AS (SELECT b.*, role, u, ge, ix, de, mi, hi, re, co, ga, u > 0 AND ge = 0 AS own, ge >= 2 AS scaffold, mi > 0 OR broken > 0 AS lost, ix + de + hi > 0 OR (u > 0 AND ge = 0) AS memory FROM b JOIN roles USING (k) JOIN phrases USING (g)),
 sec AS (SELECT *, CASE role WHEN 'mixed' THEN CASE WHEN u > 0 AND NOT scaffold THEN 'preserve ignore medium' WHEN scaffold AND u = 0 THEN 'reduce reduce medium' ELSE 'needs_human_review needs_human_review high' END
   WHEN 'decision_index' THEN CASE WHEN lost AND memory THEN 'preserve link medium' WHEN hi > 0 OR (memory AND NOT scaffold) THEN 'preserve accept low' WHEN scaffold AND NOT memory THEN 'reduce reduce medium' ELSE 'needs_human_review link medium' END
   WHEN 'research_note' THEN CASE WHEN co > 0 THEN 'needs_human_review link medium' WHEN ga > 0 THEN 'preserve link medium' WHEN (re > 0 OR own) AND NOT scaffold THEN 'preserve link low' WHEN scaffold AND re = 0 AND NOT own THEN 'reduce reduce medium' ELSE 'needs_human_review link medium' END
   WHEN 'review_or_decision_record' THEN CASE WHEN (de > 0 OR own) AND NOT scaffold THEN 'preserve accept low' WHEN scaffold AND de = 0 AND NOT own THEN 'reduce reduce medium' ELSE 'needs_human_review needs_human_review medium' END END AS told,
  CASE role WHEN 'mixed' THEN 'section-preserve-reduce' WHEN 'decision_index' THEN CASE WHEN lost THEN 'decision-index-target-missing' WHEN hi > 0 THEN 'decision-index-historical-snapshot' ELSE 'decision-index-section-preserve-reduce' END
   WHEN 'research_note' THEN CASE WHEN co > 0 THEN 'research-note-conflict' WHEN ga > 0 THEN 'research-note-evidence-gap' ELSE 'research-note-section-preserve-reduce' END ELSE 'decision-record-section-preserve-reduce' END AS scenario,
  CASE role WHEN 'mixed' THEN 0.45::DOUBLE + (u + ge) / 10 WHEN 'decision_index' THEN 0.48::DOUBLE + (ix + mi + hi) / 12 + de / 14 + (u + ge) / 18 + broken / 10 WHEN 'research_note' THEN 0.5::DOUBLE + re / 12 + co / 10 + ga / 10 + u / 14 + ge / 16 ELSE 0.45::DOUBLE + (de + u + ge) / 12 END AS sure FROM p WHERE g < 8 AND role IN ('mixed', 'decision_index', 'research_note', 'review_or_decision_record')),
 sections AS (SELECT file, 'section_triage' AS kind, scenario, role, CASE WHEN sure < 0.7 OR split_part(told, ' ', 3) = 'high' THEN 'needs_human_review' ELSE split_part(told, ' ', 1) END AS action, split_part(told, ' ', 2) AS shape, sure, split_part(told, ' ', 3) AS risk FROM sec WHERE NOT (role = 'decision_index' AND told = 'preserve accept low' AND hi = 0)),
 scored AS (SELECT *, 1 + least(2, backs) - CASE WHEN role = 'historical_archive' THEN 2 ELSE 0 END AS score FROM p WHERE g = 8),
 best AS (SELECT *, row_number() OVER (ORDER BY score DESC, file) AS nth, coalesce(lead(score) OVER (ORDER BY score DESC, file), 0) AS second FROM scored),
 owners AS (SELECT file, 'canonical_owner_candidate' AS kind, 'neon-live-status' AS scenario, role, 'needs_human_review' AS action, 'needs_human_review' AS shape, 0.45::DOUBLE + score / 12 + greatest(0, score - second) / 15 AS sure, 'medium' AS risk FROM best WHERE nth = 1),
 lives AS (SELECT file, 'live_status_triage', 'neon-live-status-stale', role, 'needs_human_review', CASE WHEN role = 'historical_archive' THEN 'archive' ELSE 'reduce' END, 0.4::DOUBLE + 5 / (85 + (k % 50 = 7)::INT + (SELECT k % 50 = 7 FROM best WHERE nth = 1)::INT) / 1.4 + 2 / 12, CASE WHEN role IN ('mixed', 'unknown') THEN 'high' ELSE 'medium' END FROM best WHERE nth > 1),
 dives AS (SELECT file, 'section_triage', 'neon-deep-dive-protection', role, 'preserve', 'ignore', 0.88::DOUBLE, 'low' FROM p WHERE role = 'research_deep_dive' AND backs > 0 AND u > 0 AND g < 8),
 alone AS (SELECT file, role, CASE WHEN role = 'decision_index' AND (broken > 0 OR g = 4) THEN 'preserve link 0.84 medium' WHEN role = 'decision_index' AND outs >= 2 THEN 'preserve ignore 0.86 low' WHEN f = 4 AND outs >= 3 THEN 'preserve ignore 0.92 low' WHEN role = 'historical_archive' THEN 'preserve ignore 0.82 low'
   WHEN role = 'research_deep_dive' THEN 'preserve link 0.86 low' WHEN role = 'review_or_decision_record' AND outs >= 2 THEN 'preserve ignore 0.85 low' WHEN role = 'review_or_decision_record' THEN 'preserve link 0.8 medium' WHEN role = 'research_note' AND ga > 0 THEN 'preserve link 0.82 medium'
   WHEN role = 'research_note' THEN 'preserve link 0.8 medium' WHEN outs = 0 THEN 'needs_human_review link 0.74 medium' ELSE 'needs_human_review link 0.62 medium' END AS told FROM p WHERE backs = 0),
 orphans AS (SELECT file, 'orphan_triage', 'orphan-actionability', role, split_part(told, ' ', 1), split_part(told, ' ', 2), split_part(told, ' ', 3)::DOUBLE, split_part(told, ' ', 4) FROM alone),
 named AS (SELECT *, 'lonelyentity' || translate(k::VARCHAR, '0123456789', 'abcdefghij') AS e FROM p WHERE k % 50 = 7),
 gaps AS (SELECT file, 'gap_triage', 'gap-explainability', role, 'needs_human_review', 'link', 0.76::DOUBLE, 'medium' FROM named ORDER BY least(5, len(e) // 3) DESC, e LIMIT 5)
 SELECT file AS source_file, kind AS finding_type, scenario AS acceptance_scenario_id, role AS doc_role, action AS suggested_action, shape AS expected_human_action_shape, round_even(sure, 3) AS confidence, risk
 FROM (FROM sections UNION ALL FROM owners UNION ALL FROM lives UNION ALL FROM dives UNION ALL FROM orphans UNION ALL FROM gaps)""")
def hygiene_whole(spark, sf_dir):
    s, links = _triaged(spark, sf_dir)
    meta = spark.createDataFrame([], "file_path string, title string, tags array<string>")
    found = hygiene.findings(s, meta, links)
    return found.select("source_file", "finding_type", "acceptance_scenario_id", "doc_role", "suggested_action", "expected_human_action_shape", "confidence", "risk")

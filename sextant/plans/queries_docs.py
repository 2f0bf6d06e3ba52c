"""Queries of the docs index, over the stand-ins of `standins`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.functions import text as X
from sextant.functions import vectors as V
from sextant.operators import docs, hygiene, markdown, scan
from sextant.plans import index
from sextant.plans import standins as S
from sextant.plans.queries import line_table, query
from sextant.plans.standins import DOCS, SQL_PATH
from sextant.plans.storage import semantic_state

_T = "text"


@query(f"""WITH {DOCS}, t AS (SELECT source, tag, row_number() OVER (PARTITION BY source ORDER BY min(doc_id), tag) AS k FROM (SELECT source, doc_id, unnest([lang, source]) AS tag FROM docs) GROUP BY 1, 2)
 SELECT source AS directory, count(*) AS docs, count(*) AS sections, string_agg('d' || doc_id || '.md', ', ' ORDER BY 'd' || doc_id || '.md') AS file_list, source AS titles, (SELECT string_agg(tag, ', ' ORDER BY k) FROM t WHERE t.source = docs.source AND k <= 8) AS top_tags FROM docs GROUP BY 1""")
def doc_catalog(spark, sf_dir):
    return docs.catalog(S.doc_sections(spark, sf_dir))


@query(f"""WITH {DOCS} SELECT d.file_path, m.title, m.status, 1 AS sections, (SELECT string_agg(source_file || '#' || link_text, ', ' ORDER BY source_file, link_text) FROM links l WHERE l.target_resolved = d.file_path) AS backlinks,
 (SELECT string_agg(coalesce(target_resolved, '⚠ ' || target_path), ', ' ORDER BY coalesce(target_resolved, '⚠ ' || target_path)) FROM links l WHERE l.source_file = d.file_path) AS outlinks, NULL::VARCHAR AS error FROM docs d LEFT JOIN meta m USING (file_path) WHERE doc_id = 7""")
def doc_context(spark, sf_dir):
    out = docs.context(S.doc_sections(spark, sf_dir), S.doc_links(spark, sf_dir), S.frontmatters(spark, sf_dir), "d7.md")
    back = F.array_sort(F.transform("backlinks", lambda x: F.concat(x["source_file"], F.lit("#"), x["link_text"])))
    return out.select("file_path", "title", "status", F.size("sections").alias("sections"), F.array_join(back, ", ").alias("backlinks"), F.array_join(F.array_sort("outlinks.to"), ", ").alias("outlinks"), "error")


@query(f"""WITH {DOCS} SELECT d.file_path, sha256(text) AS body, (SELECT string_agg(DISTINCT source_file || ' :: ' || source_heading, ', ' ORDER BY source_file || ' :: ' || source_heading) FROM links l WHERE l.target_resolved = d.file_path) AS backlinks FROM docs d WHERE doc_id = 7""")
def doc_expand(spark, sf_dir):
    s = S.doc_sections(spark, sf_dir)
    target = s.filter("doc_id = 7").first().chunk_id
    return docs.expand(s, S.doc_links(spark, sf_dir), target).select("file_path", F.sha2("content", 256).alias("body"), F.array_join("backlinks", ", ").alias("backlinks"))


@query(f"""WITH {DOCS}, b AS (SELECT target_resolved AS file_path, count(*) AS backlinks FROM links WHERE target_resolved IS NOT NULL GROUP BY 1)
 SELECT d.file_path, 1::BIGINT AS sections, n_chars AS words, coalesce(b.backlinks, 0)::BIGINT AS backlinks, m.title, m.tags, 'd' || doc_id || '.md' AS file FROM docs d LEFT JOIN b USING (file_path) LEFT JOIN meta m USING (file_path) WHERE contains(lower(d.file_path), 'd1')""")
def doc_files(spark, sf_dir):
    return docs.files(S.doc_sections(spark, sf_dir), S.doc_links(spark, sf_dir), S.frontmatters(spark, sf_dir), "D1")


@query(f"""WITH {DOCS} SELECT source_file AS "from", source_heading AS section, link_text AS text, line, CASE WHEN target_resolved IS NULL THEN '✗' ELSE '✓' END AS resolved FROM links
 WHERE regexp_matches(coalesce(target_resolved, ''), '(^|/)d7\\.md$') OR regexp_matches(target_path, '(^|/)d7\\.md$')""")
def doc_backlinks(spark, sf_dir):
    return docs.backlinks(S.doc_links(spark, sf_dir), "D7.md")


@query(f"""WITH {DOCS} SELECT coalesce(target_resolved, target_path) AS "to", link_text AS text, source_heading AS section, line FROM links WHERE regexp_matches(source_file, '(^|/)d7\\.md$')""")
def doc_links(spark, sf_dir):
    return docs.links_of(S.doc_links(spark, sf_dir), "d7.md")


@query(f"WITH {DOCS} SELECT source_file, line, target_path, target_resolved FROM links")
def resolve_links(spark, sf_dir):
    return S.doc_links(spark, sf_dir).select("source_file", "line", "target_path", "target_resolved")


@query(f"WITH {DOCS} SELECT file_path, 1::BIGINT AS sections FROM docs WHERE file_path NOT IN (SELECT target_resolved FROM links WHERE target_resolved IS NOT NULL)")
def doc_orphans(spark, sf_dir):
    return docs.orphans(S.doc_sections(spark, sf_dir), S.doc_links(spark, sf_dir))


@query(f"""WITH {DOCS} SELECT source_file AS "from", target_path AS target, link_text AS text, source_heading AS section, line FROM links WHERE target_resolved IS NULL""")
def doc_broken(spark, sf_dir):
    return docs.broken(S.doc_links(spark, sf_dir))


_STEP = "regexp_extract({0}.dst, '[^/]*$') || ' (' || {0}.via || ')'"


@query(f"""WITH {DOCS}, e AS (SELECT source_file AS src, target_resolved AS dst, arg_min(link_text, line) AS via FROM links WHERE target_resolved IS NOT NULL GROUP BY 1, 2), a AS (SELECT e.*, 'd7.md → ' || {_STEP.format("e")} AS trail FROM e JOIN docs ON src = file_path WHERE doc_id = 7)
 SELECT 1 AS hop, src, dst AS path, via, trail FROM a UNION ALL SELECT 2, e.src, e.dst, e.via, a.trail || ' → ' || {_STEP.format("e")} FROM a JOIN e ON e.src = a.dst WHERE e.dst <> a.src""")
def doc_walk(spark, sf_dir):
    start = S.doc_sections(spark, sf_dir).filter("doc_id = 7").first().file_path
    return docs.walk(S.doc_links(spark, sf_dir), start, 2)


@query(f"""WITH {DOCS}, e AS (SELECT target_resolved AS src, source_file AS dst, arg_min(link_text, line) AS via FROM links WHERE target_resolved IS NOT NULL GROUP BY 1, 2)
 SELECT 1 AS hop, src, dst AS path, via, 'd7.md → ' || {_STEP.format("e")} AS trail FROM e JOIN docs ON src = file_path WHERE doc_id = 7""")
def doc_walk_in(spark, sf_dir):
    start = S.doc_sections(spark, sf_dir).filter("doc_id = 7").first().file_path
    return docs.walk(S.doc_links(spark, sf_dir), start, 1, "in")


_COS = "list_cosine_similarity(e.embedding::DOUBLE[], q.v)"
_NOVELTY = f"""q AS (SELECT item_id, text, list_transform(list_zip(a.embedding, b.embedding), lambda x: x[1]::DOUBLE + x[2]::DOUBLE) AS v FROM benchmark JOIN embeddings a ON a.vec_id = item_id JOIN embeddings b ON b.vec_id = item_id + 40),
 s AS (SELECT item_id, text, max({_COS}) AS s, arg_max('v' || vec_id, struct_pack(s := {_COS}, k := -vec_id)) AS near FROM q, embeddings e GROUP BY 1, 2),
 n AS (SELECT *, (2 * len(list_filter([' should ', ' must ', ' always ', ' never ', ' when ', ' ensure ', ' requires ', ' depends on ', ' means that ', ' because ', ' therefore ', ' so that ', ' in order to ', ' consequence ', ' implies ', ' leads to '], lambda p: contains(lower(text), p)))
   + len(list_filter([' is a ', ' are ', ' defines ', ' represents ', ' consists of ', ' handles ', ' processes '], lambda p: contains(lower(text), p))) - 2 * len(list_filter([' maybe ', ' perhaps ', ' i wonder ', ' not sure ', ' might ', ' could be ', ' i think ', '?'], lambda p: contains(lower(text), p)))
   + 2 * len(regexp_extract_all(text, '\\b\\w+\\.(fs|cs|js|ts|py|md)\\b')) - CASE WHEN length(text) < 50 THEN 2 ELSE 0 END)::INT AS signal FROM s),
 novel AS (SELECT CASE WHEN length(text) > 120 THEN text[1:120] || '...' ELSE text END AS paragraph, CASE WHEN s < 0.5 THEN 'off-topic' WHEN signal < 0 OR (signal < 1 AND s < 0.6) THEN 'musing' WHEN s >= 0.75 THEN 'covered' ELSE 'novel' END AS status,
   round_even(s, 3) AS score, signal, near AS near_section FROM n)"""


def _novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paragraphs of the benchmark, each with the sum of two vectors of the index as its own."""
    e = S.table(spark, sf_dir, "embeddings")
    b = S.table(spark, sf_dir, "benchmark").withColumn("other", F.col("item_id") + 40)
    one, two = (e.select(F.col("vec_id").alias(k), F.col("embedding").alias(v)) for k, v in (("item_id", "_a"), ("other", "_b")))
    texts = b.join(one, "item_id").join(two, "other").select(F.col("text").alias("paragraph"), F.zip_with("_a", "_b", lambda x, y: x.cast("double") + y.cast("double")).alias("emb"))
    vectors = e.select(F.concat(F.lit("x/g"), F.col("label").cast("string"), F.lit(".md")).alias("file_path"), F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("heading"), F.col("embedding").cast("array<double>").alias("emb"), F.col("vec_id").alias("ord"))
    return docs.novelty(texts, vectors)


@query(f"WITH {_NOVELTY} SELECT paragraph, status, score, signal, near_section FROM novel")
def novelty(spark, sf_dir):
    return _novelty(spark, sf_dir).select("paragraph", "status", "score", "signal", "near_section")


@query(f"WITH {_NOVELTY} SELECT status, count(*) AS count FROM novel GROUP BY 1")
def check(spark, sf_dir):
    return index.check(_novelty(spark, sf_dir))


@query("""SELECT doc_id, paragraph FROM (SELECT doc_id, unnest(string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10))) AS paragraph FROM documents) WHERE length(trim(paragraph)) > 30 AND NOT starts_with(trim(paragraph), '|')""")
def paragraphs(spark, sf_dir):
    d = S.table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return docs.paragraph_rows(d).select("doc_id", "paragraph")


# Markdown ----------------------------------------------------------------------


def _markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Markdown file for each labelled document, with front matter, three headings, links and a fence."""
    d = S.table(spark, sf_dir, "documents").join(S.table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "lang", "source", "quality")
    i, j = F.col("doc_id").cast("string"), (F.col("doc_id") + 1).cast("string")
    text = F.concat(
        F.lit('---\nid: g'), i, F.lit('\ntitle: "Title '), i, F.lit('"\nstatus: s'), F.col("quality").cast("string"), F.lit("\ntags: "), F.col("lang"), F.lit(", "), F.col("source"), F.lit("; x\nowner: me\n---\nOpening words of "), i,
        F.lit(".\n# Part of "), F.col("source"), F.lit("\nSee [next](f"), j, F.lit(".md) and [[f"), i, F.lit("]] or [web](http://a/b.md).\n## Sub\n- a bullet\nThis is the line that sums it up.\n```\n[no](link.md)\n```\n# Empty\n# Last "), i, F.lit("\n[gone](gone.md)"),
    )
    return d.select("doc_id", F.concat(F.lit("md/f"), i, F.lit(".md")).alias("file_path"), text.alias("content"))


@query("""SELECT 'md/f' || doc_id || '.md' AS file_path, 'g' || doc_id AS id, 'Title ' || doc_id AS title, 's' || quality AS status, lang || '|' || source || '|x' AS tags, 'owner=me' AS extra FROM documents JOIN labels USING (doc_id)""")
def md_front_matter(spark, sf_dir):
    m = markdown.front_matter(_markdown(spark, sf_dir))
    return m.select("file_path", "id", "title", "status", F.array_join("tags", "|").alias("tags"), F.concat(F.lit("owner="), F.col("extra")["owner"]).alias("extra"))


@query("""WITH d AS (SELECT doc_id, lang, source, quality, 'md/f' || doc_id || '.md' AS file_path, 'Title ' || doc_id AS t FROM documents JOIN labels USING (doc_id))
 SELECT file_path, 0 AS level, t AS heading, t AS heading_path, 8 AS start_line, 8 AS end_line, 'Opening words of ' || doc_id || '.' AS summary, 0 AS links FROM d
 UNION ALL SELECT file_path, 1, 'Part of ' || source, t || ' > Part of ' || source, 9, 10, 'See [next](f' || (doc_id + 1) || '.md) and [[f' || doc_id || ']] or [web](http://a/b.md).', 2 FROM d
 UNION ALL SELECT file_path, 2, 'Sub', t || ' > Part of ' || source || ' > Sub', 11, 16, 'This is the line that sums it up.', 0 FROM d
 UNION ALL SELECT file_path, 1, 'Last ' || doc_id, t || ' > Last ' || doc_id, 18, 19, '[gone](gone.md)', 1 FROM d""")
def md_sections(spark, sf_dir):
    s = markdown.sections(_markdown(spark, sf_dir), fence_aware=True)
    return s.select("file_path", "level", "heading", "heading_path", "start_line", "end_line", "summary", F.size("out_links").alias("links"))


@query("""WITH d AS (SELECT doc_id, source, 'md/f' || doc_id || '.md' AS file_path FROM documents JOIN labels USING (doc_id)), l AS (
 SELECT file_path AS source_file, 'Part of ' || source AS source_heading, 'f' || (doc_id + 1) || '.md' AS target_path, 'next' AS link_text, 'md/f' || (doc_id + 1) || '.md' AS t FROM d
 UNION ALL SELECT file_path, 'Part of ' || source, 'f' || doc_id, 'f' || doc_id, file_path FROM d UNION ALL SELECT file_path, 'Last ' || doc_id, 'gone.md', 'gone', NULL FROM d)
 SELECT source_file, source_heading, target_path, link_text, d.file_path AS target_resolved FROM l LEFT JOIN d ON l.t = d.file_path""")
def md_links(spark, sf_dir):
    files = _markdown(spark, sf_dir)
    return markdown.links(markdown.sections(files, fence_aware=True), files).select("source_file", "source_heading", "target_path", "link_text", "target_resolved")


@query("""WITH d AS (SELECT doc_id, 'md/f' || doc_id || '.md' AS file_path FROM documents JOIN labels USING (doc_id)) SELECT 'search_document: ' || file_path || chr(10) || 'Opening words of ' || doc_id || '.' AS text FROM d""")
def md_embedding_text(spark, sf_dir):
    s = markdown.doc_sections(markdown.sections(_markdown(spark, sf_dir), fence_aware=True)).filter("level = 0")
    return s.select(markdown.embedding_text(F.col("file_path"), F.col("summary")).alias("text"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
 h AS (SELECT doc_id, n, line AS heading, (length(line) % 5)::INT AS level FROM l)
 SELECT a.doc_id, a.n::INT AS start_line, a.level, (SELECT string_agg(b.heading, ' > ' ORDER BY b.n) FROM h b WHERE b.doc_id = a.doc_id AND (b.n = a.n OR (b.n < a.n AND b.level < (SELECT min(c.level) FROM h c WHERE c.doc_id = a.doc_id AND c.n > b.n AND c.n <= a.n)))) AS path FROM h a""")
def heading_path(spark, sf_dir):
    rows = line_table(spark, sf_dir).withColumn("level", (F.length("content") % 5).cast("int")).withColumn("heading", F.col("content"))
    return markdown.with_heading_path(rows, "doc_id", "start_line", "path").select("doc_id", "start_line", "level", "path")


# Windows and health --------------------------------------------------------------


@query("""WITH l AS (SELECT unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents WHERE doc_id = 7) SELECT (n - 2)::INT AS distance, n::INT AS start_line, line AS content FROM l WHERE n BETWEEN -1 AND 5""")
def one_neighborhood(spark, sf_dir):
    return scan.neighborhood(line_table(spark, sf_dir), "7:2").select("distance", "start_line", "content")


def _times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When files were changed: a document's length in hours after the start of a year."""
    d = S.table(spark, sf_dir, "documents")
    return d.select(S.path().alias("file_path"), (F.to_timestamp(F.lit("2024-01-01 00:00:00")) + F.make_interval(hours=F.least(F.col("n_chars"), F.lit(20_000)).cast("int"))).alias("modified"))


_STALE = f"""{DOCS}, st AS (SELECT DISTINCT a.file_path, b.file_path AS target_file, (least(b.n_chars, 20000) - least(a.n_chars, 20000)) / 24.0 AS days_newer, m.slack
  FROM (SELECT doc_id, doc_id + 1 AS o, 0.0 AS slack FROM docs JOIN labels USING (doc_id) UNION ALL SELECT doc_id, doc_id + 2, 1.0 FROM docs) m JOIN docs a ON a.doc_id = m.doc_id JOIN docs b ON b.doc_id = m.o WHERE least(b.n_chars, 20000) - least(a.n_chars, 20000) > 24 * m.slack)"""


def _stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = S.table(spark, sf_dir, "documents").select(S.path().alias("file_path"), F.concat(F.lit("d"), (F.col("doc_id") + 2).cast("string"), F.lit(".md")).alias("target"))
    return docs.stale(S.frontmatters(spark, sf_dir), _times(spark, sf_dir), named)


@query(f"WITH {_STALE} SELECT DISTINCT file_path, target_file, round(days_newer::DOUBLE, 6) AS days_newer FROM st")
def stale(spark, sf_dir):
    return _stale(spark, sf_dir).select("file_path", "target_file", F.round("days_newer", 6).alias("days_newer"))


@query(f"""WITH {_STALE}, c AS (SELECT 'orphans' AS what, (SELECT count(*) FROM docs WHERE file_path NOT IN (SELECT target_resolved FROM links WHERE target_resolved IS NOT NULL)) AS n UNION ALL SELECT 'broken', (SELECT count(*) FROM links WHERE target_resolved IS NULL)
 UNION ALL SELECT 'stale', (SELECT count(*) FROM (SELECT DISTINCT file_path, target_file, days_newer FROM st)) UNION ALL SELECT 'dense_folders', (SELECT count(*) FROM (SELECT 1 FROM docs GROUP BY lang, source HAVING count(*) >= 8))) SELECT what, n FROM c UNION ALL SELECT 'total', sum(n)::BIGINT FROM c""")
def health(spark, sf_dir):
    return index.health(S.doc_sections(spark, sf_dir), S.doc_links(spark, sf_dir), _stale(spark, sf_dir))


@query(f"""SELECT CASE WHEN (SELECT count(*) FROM documents) = (SELECT count(*) FROM embeddings) THEN 'full' ELSE 'degraded' END AS whole, 'full' AS own""")
def semantic_states(spark, sf_dir):
    d, e = S.table(spark, sf_dir, "documents"), S.table(spark, sf_dir, "embeddings")
    return spark.createDataFrame([(semantic_state(d, e, "embedding"), semantic_state(e, e, "embedding"))], "whole string, own string")


@query("""SELECT vec_id, 32 AS n, CASE WHEN label % 3 = 0 THEN 0.0 WHEN label % 3 = 1 THEN round(list_sum(embedding[1:32]::DOUBLE[]), 4) ELSE round(list_sum(embedding[1:8]::DOUBLE[]), 4) END AS total FROM embeddings""")
def fitted_vectors(spark, sf_dir):
    """Vectors of three lengths, one of them none, brought to one."""
    e = S.table(spark, sf_dir, "embeddings")
    kind = F.col("label") % 3
    cut = F.when(kind == 0, F.array().cast("array<float>")).when(kind == 1, F.col("embedding")).otherwise(F.slice("embedding", 1, 8))
    rows = e.withColumn("emb", V.fitted(cut, 32))
    return rows.select("vec_id", F.size("emb").alias("n"), F.round(F.aggregate("emb", F.lit(0.0), lambda a, x: a + x.cast("double")), 4).alias("total"))


# Functions over text ---------------------------------------------------------------

_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


@query(rf"""WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents)
 SELECT doc_id, {_STRIP.format(r"list_filter(ls, lambda x: NOT regexp_matches(trim(x), '^$|^(//|#|/\*|\*|\[<|@)|^[\[\]{}();]+$'))[1]")} AS preview,
 array_to_string(list_transform(list_filter(ls, lambda x: regexp_matches(x, '(?i)de'))[1:3], lambda x: {_STRIP.format("x")}), ' | ') AS three,
 CASE WHEN length(s) > 120 THEN s[1:117] || '...' ELSE s END AS snippet, len(regexp_extract_all(text, '(?i)\ba-[a-z0-9]{{8}}\b'))::INT AS artifacts FROM (SELECT *, coalesce({_STRIP.format("list_filter(ls, lambda x: " + _STRIP.format("x") + " <> '')[1]")}, '') AS s FROM l)""")
def line_functions(spark, sf_dir):
    d = S.table(spark, sf_dir, "documents")
    return d.select("doc_id", X.preview_line(_T).alias("preview"), X.match_lines(_T, "(?i)de").alias("three"), X.first_snippet(_T).alias("snippet"), X.artifact_ids(_T).alias("artifacts"))


@query(r"""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '\b[0-9]+\b', '#', 'g'), '[^\p{L}\p{M}\p{N}_\s#]', ' ', 'g'), '\s+', ' ', 'g')) AS status FROM documents WHERE lang = 'en'""")
def status_text(spark, sf_dir):
    return S.table(spark, sf_dir, "documents").filter("lang = 'en'").select("doc_id", X.status_text(_T).alias("status"))


@query(f"""WITH {DOCS}, p AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'the current status is red' WHEN doc_id % 4 = 1 THEN 'not the current gate, yet the active wave' WHEN doc_id % 4 = 2 THEN 'next gate: Delivery Engine' ELSE 'plain deliveryengine text' END AS t, n_chars / 10000.0 AS c FROM docs)
 SELECT doc_id, doc_id % 4 IN (0, 2) AS claims, doc_id % 4 IN (2, 3) AS mentions, CASE WHEN c < 0.7 OR doc_id % 4 = 3 THEN 'needs_human_review' WHEN doc_id % 4 = 0 THEN 'link' WHEN doc_id % 4 = 1 THEN 'reduce' ELSE 'archive' END AS action,
 greatest(0.0, least(1.0, c))::DOUBLE AS clamped, '{{"doc_id":' || doc_id || ',"lang":"' || lang || '"}}' AS json FROM p JOIN docs USING (doc_id)""")
def decision_functions(spark, sf_dir):
    d = S.table(spark, sf_dir, "documents")
    k, c = F.col("doc_id") % 4, F.col("n_chars") / 10000
    t = F.when(k == 0, "the current status is red").when(k == 1, "not the current gate, yet the active wave").when(k == 2, "next gate: Delivery Engine").otherwise("plain deliveryengine text")
    proposed = F.when(k == 0, "replace_with_pointer").when(k == 1, "compact").otherwise("move_to_archive")
    action = X.normalize_action(X.determine_action(proposed, c, F.when(k == 3, "high").otherwise("low")))
    return d.select("doc_id", X.claims_authority(t).alias("claims"), X.mentions_entity(t, F.lit("delivery.engine")).alias("mentions"), action.alias("action"), X.clamp01(c).alias("clamped"), X.as_json("doc_id", "lang").alias("json"))


@query("""WITH n AS (SELECT l_suppkey AS s, list_distinct(list(l_partkey) FILTER (WHERE l_partkey > 9)) AS ps FROM lineitem GROUP BY 1) SELECT 'notes/S' || s || '.md' AS file_path, len(ps) AS parts FROM n""")
def entities(spark, sf_dir):
    """Entities of the notes that name a part, whether or not it came back; those of fewer than three letters are none."""
    e = S.notes(spark, sf_dir).select("file_path", F.explode(X.entity_refs("content")).alias("e")).filter(F.col("e").rlike(r"^[pq]\d+$"))
    return e.groupBy("file_path").agg(F.count_distinct(F.substring("e", 2, 20)).alias("parts"))


@query("""WITH t AS (SELECT doc_id AS k, unnest(list_distinct(regexp_extract_all(lower(coalesce(source, '') || chr(10) || text), '([a-z0-9]{3,})', 1))) AS w FROM documents), n AS (SELECT k, count(*) AS m FROM t GROUP BY 1),
 p AS (SELECT a.k, b.k AS o, count(*) AS c FROM t a JOIN t b ON a.w = b.w AND a.k <> b.k GROUP BY 1, 2), j AS (SELECT p.k, p.o, p.c / (x.m + y.m - p.c) AS s FROM p JOIN n x ON x.k = p.k JOIN n y ON y.k = p.o)
 SELECT k AS doc_id, arg_max(o, struct_pack(s := s, o := o)) AS near, round(max(s), 6) AS similarity FROM j WHERE s >= 0.5 GROUP BY 1""")
def section_similarity(spark, sf_dir):
    s = S.doc_sections(spark, sf_dir)
    return hygiene.similar_sections(s, "doc_id", 0.5).select("doc_id", "near", F.round("similarity", 6).alias("similarity"))


@query(f"""WITH {DOCS} SELECT d.file_path, coalesce(m.title, 'd' || doc_id) AS title, coalesce(m.tags, '') AS tags, (SELECT count(*) FROM links l WHERE l.target_resolved = d.file_path)::INT AS backlinks, (SELECT count(*) FROM links l WHERE l.source_file = d.file_path) AS outlinks,
 (SELECT count(*) FROM links l WHERE l.source_file = d.file_path AND l.target_resolved IS NULL) AS broken_links, lang || ' > ' || source AS "primary", sha256(source || chr(10) || text) AS body FROM docs d LEFT JOIN meta m USING (file_path)""")
def doc_profiles(spark, sf_dir):
    p = hygiene.profiles(S.doc_sections(spark, sf_dir), S.frontmatters(spark, sf_dir), S.doc_links(spark, sf_dir))
    return p.select("file_path", "title", F.array_join("tags", ", ").alias("tags"), "backlinks", "outlinks", "broken_links", "primary", F.sha2("text", 256).alias("body"))

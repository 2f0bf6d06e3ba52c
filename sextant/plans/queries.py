"""The driver's queries over its tables, and the SQL that they are held against.

Its tables stand in for an index: a document is a section (of the file lang/source/dN.md), its lines are sections where order
matters; embeddings are section vectors; events are reports. `queries_code`, `queries_docs` and `queries_rules` add the primitives of the two indexes
and the triage, over the tables of `standins`. Every query calls its operator; the SQL has its own terms.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.functions import text as X
from sextant.functions import vectors as V
from sextant.operators import docs, scan
from sextant.plans import index
from sextant.plans.standins import SQL_PATH, path, table
from sextant.schema import chunk_id

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a section with its text."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.col("doc_id").alias("ord"), path().alias("file_path"), F.col("lang").alias("kind"), F.col("source").alias("heading"), F.lit(1).alias("level"), F.col("text").alias("content"), "lang", "source", "n_chars")


def line_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line of a document as a chunk; its name is its place, its level (0 to 6) comes from its length."""
    d = table(spark, sf_dir, "documents").select("doc_id", path().alias("file_path"), F.posexplode(F.split("text", "\n")).alias("line", "content"))
    return d.select("doc_id", "file_path", (F.col("line") + 1).alias("start_line"), "content", (F.shiftleft("doc_id", 31) + F.col("line")).alias("ord"), F.concat_ws(":", F.col("doc_id").cast("string"), (F.col("line") + 1).cast("string")).alias("chunk_id"))


def word_sql(term: str) -> str:
    return rf"(^|[^\p{{L}}\p{{N}}_]){term}([^\p{{L}}\p{{N}}_]|$)"


# Scans ---------------------------------------------------------------------


@query(r"""SELECT doc_id, lang AS kind, trim(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '(?i)ing (the|of) [a-z]+tion'))[1], ' ') AS match_line
 FROM documents WHERE regexp_matches(text, '(?i)ing (the|of) [a-z]+tion') AND lang = 'en' ORDER BY doc_id LIMIT 100""")
def grep_first_match(spark, sf_dir):
    return scan.grep(sections(spark, sf_dir), "ing (the|of) [a-z]+tion", limit=100, kind="en").select("doc_id", "kind", "match_line")


@query(rf"SELECT doc_id, sha256({SQL_PATH} || '|' || source || '|' || 1)[1:12] AS chunk_id FROM documents")
def chunk_ids(spark, sf_dir):
    return sections(spark, sf_dir).select("doc_id", chunk_id(F.col("file_path"), F.col("heading"), F.lit(1)).alias("chunk_id"))


@query("""SELECT doc_id, len(list_distinct(regexp_extract_all(lower(text), '([a-z0-9]{3,})', 1)))::INT AS tokens FROM documents""")
def token_counts(spark, sf_dir):
    return sections(spark, sf_dir).select("doc_id", F.size(X.token_set("content")).alias("tokens"))


# Lines, sections and windows -------------------------------------------------


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents), c AS (SELECT doc_id, n AS t FROM l WHERE contains(lower(line), 'worthless'))
 SELECT c.doc_id || ':' || c.t AS target, (l.n - c.t)::INT AS distance, l.n::INT AS start_line, l.line AS content FROM c JOIN l ON l.doc_id = c.doc_id AND l.n BETWEEN c.t - 3 AND c.t + 3""")
def neighborhood(spark, sf_dir):
    rows = line_table(spark, sf_dir)
    return scan.all_neighborhoods(rows, rows.filter(F.contains(F.lower("content"), F.lit("worthless")))).select("target", "distance", "start_line", "content")


# Vectors ---------------------------------------------------------------------


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[float]]:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("ord"), F.col("embedding").alias("emb"), "label")
    return e, list(e.filter("ord = 3").first().emb)


_COS = "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"


@query(f"""SELECT e.vec_id, round_even({_COS}, 3) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 3) q WHERE e.vec_id <> 3
 ORDER BY {_COS} DESC, e.vec_id LIMIT 10""")
def similar_topk(spark, sf_dir):
    e, q = _vectors(spark, sf_dir)
    return scan.similar(e, q, 10, exclude=F.col("ord") == 3).select(F.col("ord").alias("vec_id"), "score")


@query(f"""SELECT vec_id, label, round_even(s, 3) AS score FROM (SELECT e.vec_id, e.label, {_COS} AS s FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 3) q
 ORDER BY s DESC, e.vec_id LIMIT 60) WHERE label % 2 = 1 ORDER BY s DESC, vec_id LIMIT 20""")
def search_filtered(spark, sf_dir):
    e, q = _vectors(spark, sf_dir)
    return scan.search(e, q, 20, where=F.col("label") % 2 == 1).select(F.col("ord").alias("vec_id"), "label", "score")


@query(f"""WITH n AS (SELECT e.vec_id, e.label, {_COS} AS s FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 3) q ORDER BY s DESC, e.vec_id LIMIT 30)
 SELECT 'g' || label AS file_path, round_even(avg(s), 3) AS score, 'v' || arg_max(vec_id, struct_pack(s := s, k := -vec_id)) AS near_section FROM n GROUP BY label ORDER BY avg(s) DESC, file_path LIMIT 10""")
def placement(spark, sf_dir):
    e, q = _vectors(spark, sf_dir)
    e = e.select("ord", "emb", F.concat(F.lit("g"), F.col("label").cast("string")).alias("file_path"), F.concat(F.lit("v"), F.col("ord").cast("string")).alias("heading"), F.lit("").alias("heading_path"))
    return docs.placement(e, q, 10).select("file_path", "score", "near_section")


#: The nearest of the centres so far (the first of equally near ones), if at 0.7 or more, else a centre of its own; one folder has three files.
@query("""WITH RECURSIVE w AS (SELECT CASE WHEN vec_id < 3 THEN 'few' ELSE 'dir' || (label % 4) END AS d, vec_id, embedding::DOUBLE[] AS v FROM embeddings),
 m AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY vec_id) AS n FROM w WHERE d <> 'few'),
 r AS (SELECT d, n, vec_id, [v] AS c, 0 AS g FROM m WHERE n = 1 UNION ALL SELECT d, n, vec_id, CASE WHEN best < 0.7 THEN list_append(c, v) ELSE c END, (CASE WHEN best < 0.7 THEN len(c) ELSE list_position(s, best) - 1 END)::INT
  FROM (SELECT *, list_max(s) AS best FROM (SELECT m.*, r.c, list_transform(r.c, lambda x: list_cosine_similarity(x, m.v)) AS s FROM r JOIN m ON m.d = r.d AND m.n = r.n + 1)))
 SELECT d AS directory, vec_id::VARCHAR AS file_path, g AS "cluster", NULL::VARCHAR AS suggestion FROM r UNION ALL SELECT 'few', NULL, NULL, 'Folder has fewer than 4 docs — no split needed.'""")
def cluster_greedy(spark, sf_dir):
    e, _ = _vectors(spark, sf_dir)
    folder = F.when(F.col("ord") < 3, "few").otherwise(F.concat(F.lit("dir"), (F.col("label") % 4).cast("string")))
    return docs.cluster(e.select(folder.alias("directory"), F.col("ord").cast("string").alias("file_path"), "emb", "ord"), 0.7)


# Groupings -------------------------------------------------------------------


@query("SELECT lang || '/' || source AS directory, count(*) AS files FROM documents GROUP BY 1 ORDER BY files DESC, directory LIMIT 8")
def breakdown_top8(spark, sf_dir):
    return scan.breakdown(sections(spark, sf_dir))


@query("SELECT lang || '/' || source AS directory, count(*) AS files FROM documents GROUP BY 1 HAVING count(*) >= 8")
def dense_folders(spark, sf_dir):
    return scan.dense_folders(sections(spark, sf_dir))


# Tables over time --------------------------------------------------------------


@query("""SELECT event_id, user_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC)::INT AS rank FROM events) WHERE rank <= 10""")
def history_last10(spark, sf_dir):
    return index.history(table(spark, sf_dir, "events"), 10, ["user_id"], "ts", "event_id").select("event_id", "user_id", "rank")


@query("""SELECT event_id, user_id, value, value_delta FROM (SELECT *, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS value_delta, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def compare_prev(spark, sf_dir):
    return index.compare(table(spark, sf_dir, "events"), ["value"], ["user_id"], "ts", "event_id").select("event_id", "user_id", "value", "value_delta")


@query("""WITH u AS (SELECT 0 AS t, doc_id, source, lang FROM documents WHERE lang = 'fr' UNION ALL SELECT 1, doc_id, source, lang FROM documents WHERE lang = 'en')
 SELECT doc_id, source, lang FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY t, doc_id) AS r FROM u) WHERE r = 1""")
def merge_by(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.col("doc_id").alias("ord"))
    return scan.merge_by("source", d.filter("lang = 'fr'"), d.filter("lang = 'en'")).drop("ord")


@query("""SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2""")
def event_windows(spark, sf_dir):
    from sextant.streaming.incremental import event_counts

    return event_counts(table(spark, sf_dir, "events")).withColumn("total", F.round("total", 2))


# Relational smoke ----------------------------------------------------------------


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def pricing_summary(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@query(rf"""SELECT doc_id, {SQL_PATH} AS file_path, len(list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+'), lambda x: x = 'der'))::INT AS count,
 trim(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '(?i){word_sql("der")}'))[1], ' ') AS match_line FROM documents WHERE regexp_matches(text, '(?i){word_sql("der")}')""")
def mentions(spark, sf_dir):
    return scan.mentions(sections(spark, sf_dir), "der", None).select("doc_id", "file_path", "count", "match_line")


@query(r"""WITH l AS (SELECT doc_id, text, list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')) AS ls FROM documents),
 f AS (SELECT doc_id, list_filter(ls, lambda x: length(x) > 10 AND NOT starts_with(x, '#') AND NOT starts_with(x, '-') AND NOT (starts_with(x, '*') AND length(x) < 40) AND NOT starts_with(x, '|') AND NOT starts_with(x, '```') AND NOT starts_with(x, '![') AND NOT regexp_matches(x, '^\[.+\]\(.+\)$'))[1] AS p,
  regexp_replace(regexp_replace(regexp_replace(replace(replace(text, chr(10), ' '), chr(13), ' '), '^\s+|\s+$', '', 'g'), '^#+\s*', ''), '^\s+|\s+$', '', 'g') AS flat FROM l),
 s AS (SELECT doc_id, coalesce(p, CASE WHEN flat <> '' THEN flat END, '(no summary)') AS s FROM f) SELECT doc_id, CASE WHEN length(s) > 120 THEN s[1:120] || '...' ELSE s END AS summary FROM s""")
def summary_line(spark, sf_dir):
    return sections(spark, sf_dir).select("doc_id", X.summary_line("content").alias("summary"))


@query(r"""SELECT doc_id, len(list_filter(string_split_regex(text, '[ \n\t]'), lambda x: x <> ''))::INT AS words FROM documents""")
def word_counts(spark, sf_dir):
    return sections(spark, sf_dir).select("doc_id", X.word_count("content").alias("words"))


@query(r"""SELECT doc_id, (2 * len(list_filter([' should ', ' must ', ' always ', ' never ', ' when ', ' ensure ', ' requires ', ' depends on ', ' means that ', ' because ', ' therefore ', ' so that ', ' in order to ', ' consequence ', ' implies ', ' leads to '], lambda p: contains(lower(text), p)))
 + len(list_filter([' is a ', ' are ', ' defines ', ' represents ', ' consists of ', ' handles ', ' processes '], lambda p: contains(lower(text), p))) - 2 * len(list_filter([' maybe ', ' perhaps ', ' i wonder ', ' not sure ', ' might ', ' could be ', ' i think ', '?'], lambda p: contains(lower(text), p)))
 + 2 * len(regexp_extract_all(text, '\b\w+\.(fs|cs|js|ts|py|md)\b')) - CASE WHEN length(text) < 50 THEN 2 ELSE 0 END)::INT AS signal FROM documents""")
def knowledge_signal(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.knowledge_signal("text").alias("signal"))


@query(r"""WITH d AS (SELECT doc_id, text, CASE WHEN lang = 'en' THEN 'Context Snapshot' WHEN lang = 'de' THEN 'a wave' ELSE source END AS heading FROM documents)
 SELECT doc_id, regexp_matches(text, '\b20\d{2}[-/]\d{2}[-/]\d{2}\b') AS dated, (CASE WHEN regexp_matches(lower(heading), 'status|progress|current|wave|gate|baseline|platform note|context snapshot') THEN 2 ELSE 0 END
 + CASE WHEN regexp_matches(lower(heading || chr(10) || text), 'current status|current gate|active wave|delivered|tests baseline|current platform note|currently') THEN 2 ELSE 0 END
 + CASE WHEN regexp_matches(lower(heading || chr(10) || text), 'tests|passing|baseline|wave|gate') THEN 1 ELSE 0 END)::INT AS score FROM d""")
def status_scores(spark, sf_dir):
    heading = F.when(F.col("lang") == "en", "Context Snapshot").when(F.col("lang") == "de", "a wave").otherwise(F.col("source"))
    return sections(spark, sf_dir).select("doc_id", X.has_date("content").alias("dated"), X.status_score(heading, "content").alias("score"))


@query("""WITH a AS (SELECT o_orderkey AS k, o_orderstatus AS h FROM orders WHERE o_orderstatus <> 'P'), b AS (SELECT o_orderkey AS k, CASE WHEN o_orderstatus = 'O' AND o_orderpriority = '2-HIGH' THEN 'X' ELSE o_orderstatus END AS h FROM orders WHERE o_orderpriority <> '1-URGENT')
 SELECT coalesce(a.k, b.k)::VARCHAR AS file_path, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' WHEN a.h = b.h THEN 'same' ELSE 'modified' END AS change FROM a FULL JOIN b ON a.k = b.k""")
def changed_diff(spark, sf_dir):
    """Two snapshots of the orders: settled ones, and later all but urgent ones, some of which were changed."""
    o = table(spark, sf_dir, "orders")
    k, status = F.col("o_orderkey").cast("string").alias("file_path"), F.col("o_orderstatus")
    now = F.when((status == "O") & (F.col("o_orderpriority") == "2-HIGH"), "X").otherwise(status)
    return scan.hash_diff(o.filter(status != "P").select(k, F.sha2(status, 256).alias("sha256")), o.filter("o_orderpriority <> '1-URGENT'").select(k, F.sha2(now, 256).alias("sha256")))


# The primitives of the two indexes and the triage register themselves.
from sextant.plans import queries_code, queries_docs, queries_expr, queries_index, queries_rules  # noqa: E402, F401

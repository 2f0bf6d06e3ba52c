"""Keeps the index of a growing corpus of documents: a section for each heading, and the gaps between documents.

    python -m jobs.docs_index --documents PATH --out DIR --checkpoint DIR [--config jobs/docs_index.json]

PATH is a folder of Parquet files, or a pattern of files or folders. Its new data files are taken as a file stream with a checkpoint, until none is left. A document is the Markdown file
lang/source/dID.md. Of each batch, documents whose text is already indexed (by SHA-256) are left out; the others' sections go to

    OUT/sections/lang=…/epoch=…    epoch: the batch; a document that comes again with another text has its rows in a later epoch, which count
    OUT/gaps/signal=…              what documents name, by how many do, made anew from all sections when the stream has ended

A batch that is tried again has the same documents and replaces its own epoch; a run with nothing new writes the same gaps.

Defined cases: a null text is an empty document, with one section; a null or empty lang is the partition __HIVE_DEFAULT_PARTITION__; a document without
doc_id is named by its text's hash; of rows with one path in one batch the greatest text stands; further columns are ignored.
Configuration: files_per_batch bounds a batch, fence_aware ignores headings in fenced code, sample is how many files are shown of an entity.
"""

from __future__ import annotations

import argparse

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import configured, log, partitioned, started
from sextant.functions import text as X
from sextant.operators import docs, markdown
from sextant.streaming.incremental import latest

DEFAULTS = {"files_per_batch": 1000, "fence_aware": False, "sample": 5}
SECTIONS = "chunk_id string, ord long, file_path string, sha256 string, heading string, heading_path string, level int, start_line int, end_line int, summary string, word_count int, link_count int, entities array<string>, lang string, epoch long"
RESULT = ["file_path", "sha256", "lang", "ord", "heading", "heading_path", "level", "start_line", "end_line", "summary", "word_count", "link_count"]


def as_files(documents: DataFrame) -> DataFrame:
    """(file_path, lang, content, sha256), one row for each path."""
    text = F.coalesce("text", F.lit(""))
    name = F.concat(F.lit("d"), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("x"), F.substring(F.sha2(text, 256), 1, 16))), F.lit(".md"))
    rows = documents.select(F.concat_ws("/", "lang", "source", name).alias("file_path"), F.nullif("lang", F.lit("")).alias("lang"), text.alias("content"))
    return rows.groupBy("file_path").agg(F.max("lang").alias("lang"), F.max("content").alias("content")).withColumn("sha256", F.sha2("content", 256))


def indexed(spark: SparkSession, out: str) -> DataFrame:
    """All epochs of the sections, with a schema, so that an empty table is one too."""
    return spark.read.schema(SECTIONS).parquet(f"{out}/sections")


def sections_of(files: DataFrame, fence_aware: bool) -> DataFrame:
    rows = markdown.sections(files, fence_aware).join(files.select("file_path", "lang", "sha256"), "file_path")
    return rows.select(
        "chunk_id", "ord", "file_path", "sha256", "heading", "heading_path", "level", "start_line", "end_line", "summary", X.word_count("content").alias("word_count"),
        F.size("out_links").alias("link_count"), X.entity_refs("content").alias("entities"), "lang",
    )


def run(spark: SparkSession, documents: str, out: str, checkpoint: str, config: dict | None = None) -> DataFrame:
    """Takes what is new, and returns the sections of all documents as they now stand."""
    config = DEFAULTS | (config or {})
    # The table exists, without rows, before the first batch looks into it.
    spark.createDataFrame([], SECTIONS).write.mode("append").partitionBy("lang", "epoch").parquet(f"{out}/sections")

    def take(batch: DataFrame, epoch: int) -> None:
        session = batch.sparkSession
        # Only earlier epochs: what an interrupted attempt of this one has written doesn't count.
        before = indexed(session, out).filter(F.col("epoch") < epoch).groupBy("file_path").agg(F.max_by("sha256", "epoch").alias("sha256"))
        # Kept while the batch lasts: texts are read and dealt out once, though sections need them several times.
        new = as_files(batch).join(before, ["file_path", "sha256"], "left_anti").persist(StorageLevel.DISK_ONLY)
        rows = sections_of(new, config["fence_aware"]).withColumn("epoch", F.lit(epoch).cast("long"))
        rows.hint("rebalance", "lang").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("lang", "epoch").parquet(f"{out}/sections")
        new.unpersist()
        made = indexed(session, out).filter(F.col("epoch") == epoch).agg(F.count("*").alias("rows"), F.countDistinct("file_path").alias("files")).first()
        log.info("batch %d: wrote %d sections of %d documents to %s/sections", epoch, made.rows, made.files, out)

    schema = spark.read.parquet(documents).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", config["files_per_batch"]).parquet(documents)
    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    log.info("read %d new rows of %s", sum(p["numInputRows"] for p in query.recentProgress), documents)

    now = latest(indexed(spark, out))
    named = now.select("file_path", F.explode("entities").alias("entity")).distinct()
    partitioned(docs.entity_table(named, now.select("file_path").distinct(), config["sample"]), f"{out}/gaps", "signal")
    return now.select(*RESULT)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="docs-index", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("--documents", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--checkpoint", required=True)
    p.add_argument("--config")
    args, spark = started(p, argv)
    try:
        run(spark, args.documents, args.out, args.checkpoint, configured(spark, args.config, DEFAULTS))
    finally:
        spark.stop()
    return 0


#: The sections of all documents in SQL: headings outside front matter (none of the given documents has one).
SQL = r"""WITH RECURSIVE f AS (SELECT concat_ws('/', lang, source, 'd' || coalesce(doc_id::VARCHAR, 'x' || sha256(coalesce(text, ''))[1:16]) || '.md') AS file_path, nullif(max(lang), '') AS lang, max(coalesce(text, '')) AS text FROM documents GROUP BY 1),
 a AS (SELECT file_path, string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)) AS ls FROM f),
 l AS (SELECT file_path, unnest(ls) AS text, generate_subscripts(ls, 1) AS line FROM a),
 h AS (SELECT *, regexp_matches(text, '^(#{1,6})\s+(.+)$') AS h FROM l),
 n AS (SELECT *, sum(h::INT) OVER (PARTITION BY file_path ORDER BY line) AS sec FROM h),
 p AS (SELECT file_path, sec, max(CASE WHEN h THEN text END) AS head, min(line) AS start_line, max(line) AS end_line, coalesce(string_agg(CASE WHEN NOT h THEN text END, chr(10) ORDER BY line), '') AS content, count(*) FILTER (WHERE NOT h) AS body FROM n GROUP BY 1, 2
  UNION ALL SELECT file_path, 0, NULL, 1, 1, '', 0 FROM h WHERE line = 1 AND h),
 s AS (SELECT *, trim(content, ' ') AS body_text, CASE WHEN sec = 0 THEN '(intro)' ELSE trim(regexp_extract(head, '^(#{1,6})\s+(.+)$', 2), ' ') END AS heading, CASE WHEN sec = 0 THEN 0 ELSE length(regexp_extract(head, '^(#{1,6})\s+(.+)$', 1)) END AS level FROM p
  QUALIFY sec = 0 OR body > 0 OR sec = max(sec) OVER (PARTITION BY file_path)),
 o AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY sec) AS ord FROM s),
 up AS (SELECT file_path, sec AS of, sec, ord, heading, level FROM o
  UNION ALL SELECT up.file_path, up.of, b.sec, b.ord, b.heading, least(up.level, b.level) FROM up JOIN o b ON b.file_path = up.file_path AND b.ord = up.ord - 1),
 way AS (SELECT file_path, of, sec, heading, level, lag(level) OVER (PARTITION BY file_path, of ORDER BY sec DESC) AS below FROM up),
 t AS (SELECT file_path, of AS sec, string_agg(heading, ' > ' ORDER BY sec) AS heading_path FROM way WHERE below IS NULL OR level < below GROUP BY ALL),
 m AS (SELECT file_path, sec, list_transform(string_split(body_text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')) AS ls, regexp_replace(regexp_replace(regexp_replace(replace(replace(body_text, chr(10), ' '), chr(13), ' '), '^\s+|\s+$', '', 'g'), '^#+\s*', ''), '^\s+|\s+$', '', 'g') AS flat FROM o),
 u AS (SELECT file_path, sec, coalesce(list_filter(ls, lambda x: length(x) > 10 AND NOT regexp_matches(x, '^(#|-|\||```|!\[)|^\[.+\]\(.+\)$') AND NOT (starts_with(x, '*') AND length(x) < 40))[1], nullif(flat, ''), '(no summary)') AS u FROM m)
 SELECT file_path, sha256(f.text) AS sha256, f.lang, o.ord, o.heading, t.heading_path, o.level::INT AS level, o.start_line::INT AS start_line, o.end_line::INT AS end_line, CASE WHEN length(u) > 120 THEN u[1:120] || '...' ELSE u END AS summary,
  len(list_filter(string_split_regex(body_text, '[ \n\t]'), lambda x: x <> ''))::INT AS word_count,
  (len(list_filter(regexp_extract_all(regexp_replace(body_text, '(?s)```.*?```', '', 'g'), '\[([^\]]*)\]\(([^)]+)\)', 2), lambda x: ends_with(x, '.md') AND NOT starts_with(x, 'http') AND NOT starts_with(x, '#'))) + len(regexp_extract_all(regexp_replace(body_text, '(?s)```.*?```', '', 'g'), '\[\[([^\]|]+)(?:\|[^\]]*)?\]\]', 1)))::INT AS link_count
 FROM o JOIN f USING (file_path) JOIN t USING (file_path, sec) JOIN u USING (file_path, sec)"""


if __name__ == "__main__":
    raise SystemExit(main())

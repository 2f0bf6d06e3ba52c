"""Queries of the index jobs and the readers of old files: tables are written into a new shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.plans import index, queries_code, queries_docs
from sextant.plans import standins as S
from sextant.plans.queries import SQL, query
from sextant.plans.standins import CODE, DOCS
from sextant.plans.storage import Catalog, shared_folder
from sextant.sources import files as sources
from sextant.sources.embeddings import Hashed


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"


def _hashed(files: DataFrame) -> DataFrame:
    return files.withColumn("sha256", F.sha2("content", 256))


def _docs_index(spark: SparkSession, sf_dir: str) -> Catalog:
    """Built from half of the files, of which some have another text, then from all of them."""
    files = queries_docs._markdown(spark, sf_dir)
    half = files.filter("doc_id % 2 = 0").withColumn("content", F.when(F.col("doc_id") % 3 == 0, F.concat("content", F.lit("\n# Gone\nsoon"))).otherwise(F.col("content")))
    gone = spark.createDataFrame([("md/gone.md", "# Gone\nagain")], "file_path string, content string")
    catalog, config = Catalog(spark, _folder(spark)), sources.Config.load('{"doc_dirs": ["md"]}')
    index.build_docs_index(catalog, _hashed(half.select("file_path", "content").union(gone)), config)
    index.build_docs_index(catalog, _hashed(files.select("file_path", "content")), config)
    return catalog


@query(SQL["md_sections"])
def index_docs_sections(spark, sf_dir):
    s = _docs_index(spark, sf_dir).table("doc_source")
    return s.select("file_path", "level", "heading", "heading_path", "start_line", "end_line", "summary", F.size("out_links").alias("links"))


@query(SQL["md_links"])
def index_docs_links(spark, sf_dir):
    return _docs_index(spark, sf_dir).table("doc_links").select("source_file", "source_heading", "target_path", "link_text", "target_resolved")


@query("""WITH d AS (SELECT DISTINCT l_suppkey AS s FROM lineitem) SELECT 'src/shop' || s || '.py' AS file_path, name, kind, signature, summary, true AS has_vector FROM d,
 (VALUES ('sell', 'let', 'def sell(x)', 'def sell(x):'), ('Shop', 'type', 'class Shop', 'class Shop:')) v(name, kind, signature, summary)""")
def index_code_chunks(spark, sf_dir):
    """Built twice, the first time from other texts of a third of the files; the second run replaces just those and adds the rest."""
    files = queries_code._scripts(spark, sf_dir)
    other = files.filter(F.pmod(F.xxhash64("file_path"), F.lit(3)) == 0).withColumn("content", F.lit("def other():\n    pass\n"))
    catalog, config = Catalog(spark, _folder(spark)), sources.Config.load('{"src_dirs": ["src"]}')
    index.build_code_index(catalog, _hashed(other), config, Hashed(8))
    index.build_code_index(catalog, _hashed(files), config, Hashed(8))
    vectors = catalog.table("code_vectors").filter("emb is not null").select("chunk_id", F.lit(True).alias("has_vector"))
    return catalog.table("code_chunks").join(vectors, "chunk_id", "left").select("file_path", "name", "kind", "signature", "summary", "has_vector")


@query(f"""WITH {CODE} SELECT file_path, module, name, kind, start_line, end_line, sha256(content) AS body, 0::BIGINT AS lost FROM chunks
 UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, NULL, count(*) FROM chunks WHERE ord % 7 = 0""")
def read_source_lines(spark, sf_dir):
    """Chunks as JSON lines of the old kind, with lines between them that are none: those are counted."""
    c = S.code_chunks(spark, sf_dir)
    line = F.to_json(F.struct(F.col("chunk_id").alias("cid"), F.col("file_path").alias("filePath"), F.col("module").alias("moduleName"), "name", "kind", F.col("start_line").alias("startLine"), F.col("end_line").alias("endLine"), "content"))
    at = _folder(spark)
    c.select(line.alias("value")).union(c.filter("ord % 7 = 0").select(F.concat(F.lit('{"cid": '), "name"))).write.text(at)
    lost = sources.lost_lines(spark, at).agg(F.count("*").alias("lost"))
    rows = sources.legacy_source(spark, at).select("file_path", "module", "name", "kind", "start_line", "end_line", F.sha2("content", 256).alias("body"), F.lit(0).cast("long").alias("lost"))
    return rows.unionByName(lost, allowMissingColumns=True)


@query(f"WITH {CODE} SELECT file_path, module, name, kind, start_line, end_line, summary, kind || '!' AS extra FROM chunks")
def read_chunk_table(spark, sf_dir):
    """Chunks as a tab-separated table of the old kind, with a header and a column of its own."""
    c, at = S.code_chunks(spark, sf_dir), _folder(spark)
    head = spark.createDataFrame([("#fields:FilePath Module Name Kind StartLine EndLine Summary Signature Mark",)], "value string")
    cells = [F.col(k).cast("string") for k in ("file_path", "module", "name", "kind", "start_line", "end_line", "summary", "signature")]
    head.union(c.select(F.concat_ws("\t", *[F.coalesce(x, F.lit("")) for x in cells], F.concat("kind", F.lit("!"))))).write.text(at)
    return sources.legacy_chunks(spark, at).select("file_path", "module", "name", "kind", "start_line", "end_line", "summary", F.col("extra")["Mark"].alias("extra"))


@query(f"WITH {DOCS} SELECT source_file, source_heading, target_path, target_resolved, link_text, line FROM links")
def read_link_table(spark, sf_dir):
    links, at = S.doc_links(spark, sf_dir), _folder(spark)
    cells = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in ("source_file", "source_heading", "target_path", "target_resolved", "link_text", "line")]
    links.select(F.concat_ws("\t", *cells).alias("value")).write.text(at)
    return sources.legacy_links(spark, at)

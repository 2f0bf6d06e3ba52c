"""Index jobs: files to tables, whole or by what has changed; reports; health."""

from __future__ import annotations

import time
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sextant.functions import text as X
from sextant.operators import codefiles, docs, markdown, scan
from sextant.operators.bridge import FILE_TOKEN
from sextant.plans.storage import Catalog, cut, semantic_state
from sextant.schema import schema
from sextant.sources.embeddings import Fault, Provider, fill
from sextant.sources.files import Config, code_files, doc_files

LAYOUT = 1


def preflight(files: DataFrame, config: Config) -> DataFrame:
    """What an index of code would read: the eight folders with most files."""
    return scan.breakdown(code_files(files, config))


def _merged(old: DataFrame, new: DataFrame, touched: DataFrame) -> DataFrame:
    """Old rows of files that weren't touched, and the new ones."""
    return old.join(touched.select("file_path").distinct(), "file_path", "left_anti").unionByName(new, allowMissingColumns=True)


def build_code_index(catalog: Catalog, files: DataFrame, config: Config, provider: Provider | None = None, only: list[str] | None = None) -> dict:
    """Indexes what has changed since the last run (by hash), or the named files, which bypass the excludes; returns the report."""
    began = time.time()
    wanted = files.filter(F.col("file_path").isin(*only)) if only else code_files(files, config)
    now = wanted.select("file_path", "sha256")
    before = catalog.table("file_hashes")
    fresh = catalog.freshness(layout=LAYOUT, max_chunk_chars=config.max_chunk_chars) == "fresh"
    diff = cut(scan.hash_diff(before if fresh else before.limit(0), now))
    touched = diff.filter(F.col("change") != "same") if not only else now.select("file_path", F.lit("modified").alias("change"))
    if only:
        now = _merged(before, now, now)
    todo = wanted.join(touched.filter(F.col("change").isin("added", "modified")).select("file_path"), "file_path", "left_semi")
    source = codefiles.read(_merged(catalog.table("code_source"), codefiles.source_table(todo, config.max_chunk_chars), touched))
    imports = _merged(catalog.table("imports"), codefiles.extract(todo, "imports"), touched)
    refs = _merged(catalog.table("type_refs"), codefiles.type_refs(todo), touched)
    sigs = codefiles.read(codefiles.signatures(source))
    chunks = codefiles.with_signatures(source.select("chunk_id", "ord", "file_path", "module", "name", "kind", "start_line", "end_line", X.summary_line("content").alias("summary"), F.lit(None).cast("string").alias("signature"), F.lit(None).cast("map<string,string>").alias("extra")), sigs)
    tables = {"code_source": source, "imports": imports, "type_refs": refs, "signatures": sigs, "code_chunks": chunks.select(*schema("code_chunks").names), "file_hashes": now}
    state, failed = "no-embed", 0
    if provider is not None:
        texts = source.select("chunk_id", codefiles.embedding_text(F.col("module"), F.col("kind"), F.col("name"), F.col("content")).alias("text")).dropDuplicates(["chunk_id"])
        old = catalog.table("code_vectors") if catalog.version() else None
        old = old if old is not None and "text_hash" in old.columns else catalog.spark.createDataFrame([], "chunk_id string, text_hash string, emb array<float>")
        vectors = cut(fill(texts, old, provider, config.embedding_batch))
        failed = vectors.filter("emb is null").count()
        tables["code_vectors"] = vectors
        state = semantic_state(source.select("chunk_id").distinct(), vectors, "emb")
    with codefiles.few_files(files):
        catalog.save(tables, layout=LAYOUT, max_chunk_chars=config.max_chunk_chars, semantic_state=state)
    return report("code", state, began, failed, catalog.table("code_chunks").count(), catalog.table("imports").count(), sigs.count())


def build_docs_index(catalog: Catalog, files: DataFrame, config: Config, provider: Provider | None = None) -> dict:
    """Parses the files that are new or changed since the last run (by hash); of the other files' links only those are resolved anew that
    a file which came or went could answer. The tables are those of a full build."""
    began = time.time()
    md = doc_files(files, config)
    md = cut(md if "sha256" in md.columns else md.withColumn("sha256", F.sha2(F.coalesce("content", F.lit("")), 256)))
    now, before = md.select("file_path", "sha256"), catalog.table("doc_hashes")
    fresh = catalog.freshness(docs_layout=LAYOUT) == "fresh"
    diff = cut(scan.hash_diff(before if fresh else before.limit(0), now))
    touched = diff.filter(F.col("change") != "same")
    todo = md.join(touched.filter(F.col("change").isin("added", "modified")).select("file_path"), "file_path", "left_semi")

    def old(name: str) -> DataFrame:
        table = catalog.table(name)
        return table if fresh else table.limit(0)

    new = cut(markdown.sections(todo))
    source = cut(_merged(old("doc_source"), new, touched))
    others = old("doc_links").join(touched.select(F.col("file_path").alias("source_file")), "source_file", "left_anti")
    moved = diff.filter(F.col("change").isin("added", "removed"))
    links = markdown.links(new, md).unionByName(markdown.refreshed_links(others, md, moved))
    tables = {"doc_source": source, "doc_sections": markdown.doc_sections(source), "doc_links": links, "frontmatters": _merged(old("frontmatters"), markdown.front_matter(todo), touched), "doc_hashes": now}
    state, failed = "no-embed", 0
    if provider is not None:
        texts = source.select("chunk_id", markdown.embedding_text(F.col("file_path"), F.col("summary")).alias("text")).dropDuplicates(["chunk_id"])
        old = catalog.table("doc_vectors")  # vectors of sections that haven't changed are kept
        old = old.filter("emb is not null") if "text_hash" in old.columns else catalog.spark.createDataFrame([], "chunk_id string, text_hash string, emb array<float>")
        vectors = cut(fill(texts, old, provider, config.embedding_batch))
        failed = vectors.filter("emb is null").count()
        tables["doc_vectors"] = vectors
        state = semantic_state(source.select("chunk_id").distinct(), vectors, "emb")
    catalog.save(tables, docs_layout=LAYOUT, docs_semantic_state=state)
    return report("docs", state, began, failed, source.count(), links.count(), 0)


def report(kind: str, state: str, began: float, failed: int, chunks: int, imports: int, signatures: int) -> dict:
    return {
        "kind": kind, "completed_at": datetime.now(timezone.utc), "message": f"{chunks} chunks", "batches": 0, "failed_batches": failed,
        "duration_ms": int(1000 * (time.time() - began)), "semantic_state": state, "chunks": chunks, "imports": imports, "signatures": signatures,
    }


def exit_code(state: str, failed: int) -> int:
    """0: whole; 1: without some vectors; 2: nothing usable."""
    return 0 if state in ("full", "no-embed") and not failed else 1 if state == "degraded" or failed else 2


def append_report(spark: SparkSession, path: str, row: dict) -> None:
    spark.createDataFrame([tuple(row[k] for k in schema("invocations").names)], schema("invocations")).write.mode("append").parquet(path)


def history(invocations: DataFrame, k: int = 10, by: list[str] | None = None, when: str = "completed_at", tie: str | None = None) -> DataFrame:
    """The last k reports (of each group), with their rank, latest first."""
    order = [F.desc(when), *([F.desc(tie)] if tie else [])]
    w = Window.partitionBy(*(by or [F.lit(1)])).orderBy(*order)
    return invocations.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def compare(invocations: DataFrame, facts: list[str], by: list[str] | None = None, when: str = "completed_at", tie: str | None = None) -> DataFrame:
    """The latest report (of each group) with each fact's change since the one before; null where either lacks it."""
    w = Window.partitionBy(*(by or [F.lit(1)])).orderBy(*[F.asc(when), *([F.asc(tie)] if tie else [])])
    rows = invocations.withColumns({f"{f}_delta": F.col(f) - F.lag(f).over(w) for f in facts})
    return history(rows, 1, by, when, tie).drop("rank")


def health(sections: DataFrame, links: DataFrame, stale: DataFrame) -> DataFrame:
    """Counts of orphans, broken links, stale documents and crowded folders, and their total."""
    spark = sections.sparkSession
    counts = {"orphans": docs.orphans(sections, links).count(), "broken": docs.broken(links).count(), "stale": stale.count(), "dense_folders": scan.dense_folders(sections).count()}
    return spark.createDataFrame([(k, v) for k, v in [*counts.items(), ("total", sum(counts.values()))]], "what string, n long")


def check(novelty: DataFrame) -> DataFrame:
    return novelty.groupBy("status").count()


def assign_refs(rows: DataFrame, start: int = 0) -> tuple[list[dict], dict[str, str]]:
    """A small result's rows with ids R1, R2, ... in order, and what they stand for."""
    out, refs = [], {}
    for i, r in enumerate(rows.collect()):
        d = r.asDict(recursive=True)
        refs[f"R{start + i + 1}"] = d.get("chunk_id", "")
        out.append({"id": f"R{start + i + 1}", **d})
    return out, refs


def save_session(spark: SparkSession, path: str, name: str, refs: dict[str, str]) -> None:
    spark.createDataFrame([(name, k, v) for k, v in refs.items()], schema("refs")).write.mode("overwrite").parquet(f"{path}/session={name}")


def sessions(spark: SparkSession, path: str) -> DataFrame:
    """(session, refs): the saved sessions and how many references each has."""
    return spark.read.schema(schema("refs")).parquet(path).groupBy("session").agg(F.count("*").alias("refs")).orderBy("session")


def stale_docs(files: DataFrame, frontmatters: DataFrame, source: DataFrame) -> DataFrame:
    """Stale documents of an index: files as read_files gives them, source (file_path, content)."""
    named = source.select("file_path", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(FILE_TOKEN), F.lit(1)))).alias("target"))
    return docs.stale(frontmatters, files.select("file_path", "modified"), named)


def check_text(text: str, source: DataFrame, vectors: DataFrame, provider: Provider, threshold: float = 0.75) -> DataFrame:
    """Novelty of a text's paragraphs against an index. source (chunk_id, file_path, heading, ord), vectors (chunk_id, emb)."""
    spark = source.sparkSession
    found = [r.paragraph for r in docs.paragraph_rows(spark.createDataFrame([(text,)], "text string")).collect()]
    asked = [(p, [float(x) for x in v]) for p, v in zip(found, provider.embed([f"search_query: {p}" for p in found]) if found else [], strict=True)]
    rows = source.select("chunk_id", "file_path", "heading", "ord").join(vectors.select("chunk_id", "emb"), "chunk_id")
    return docs.novelty(spark.createDataFrame(asked, "paragraph string, emb array<float>"), rows, threshold)


def search_text(text: str, source: DataFrame, vectors: DataFrame, provider: Provider, column: str = "emb", limit: int = 5, prefix: str = "") -> DataFrame:
    """The rows of an index nearest to a text; the provider embeds it."""
    vector = [float(x) for x in provider.embed([prefix + text])[0]]
    return scan.search(source.join(vectors.select("chunk_id", F.col(column).alias("emb")), "chunk_id"), vector, limit).drop("emb", "content")


def load_session(spark: SparkSession, path: str, name: str) -> dict[str, str]:
    return {r.ref_id: r.chunk_id for r in spark.read.schema(schema("refs")).parquet(f"{path}/session={name}").collect()}


def embedding_fault(e: Fault) -> dict:
    return {"error": str(e), "semanticState": "degraded"}

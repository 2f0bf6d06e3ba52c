"""Markdown to sections, links and front matter: lines are exploded once, sections are runs between headings.

Input files: (file_path, content). All of it is DataFrame code: splitting, windows within a file, aggregation by section.
A window never spans files, and a file is the unit that a reader holds in memory anyway.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.functions import text as X
from sextant.plans.storage import cut
from sextant.schema import chunk_id

HEADING = r"^(#{1,6})\s+(.+)$"
#: Levels of headings; 0 is what stands before the first.
LEVELS = 7


def file_lines(files: DataFrame) -> DataFrame:
    """(file_path, line, text): lines from 1."""
    body = F.regexp_replace("content", "\r\n?", "\n")
    return files.select("file_path", F.posexplode(F.split(body, "\n")).alias("line", "text")).withColumn("line", F.col("line") + 1)


def front_matter(files: DataFrame) -> DataFrame:
    """(file_path, id, title, status, tags, related, extra): the block between two lines --- at the top, as a row for each file that has one.

    Values are on the key's line, apart by comma or semicolon in lists, or as items "- x" on the lines that follow.
    """
    block = F.regexp_extract(F.regexp_replace("content", "\r\n?", "\n"), r"(?s)\A---\n(.*?)\n---(?:\n|\z)", 1)
    has = F.col("content").rlike(r"\A---\r?\n")
    rows = files.filter(has).select("file_path", F.regexp_replace(block, r"\n\s*-\s+", ";").alias("b"))
    rows = rows.select("file_path", F.explode_outer(F.split("b", "\n")).alias("l"))
    key, value = F.lower(F.trim(F.regexp_extract("l", r"^([^:]+):", 1))), F.trim(F.regexp_extract("l", r"^[^:]+:(.*)$", 1))
    rows = rows.select("file_path", key.alias("k"), F.regexp_replace(F.regexp_replace(value, r"^;", ""), '"', "").alias("v"))

    def one(k: str) -> Column:
        return F.max(F.when(F.col("k") == k, F.col("v")))

    def many(k: str) -> Column:
        bare = F.regexp_replace(F.coalesce(one(k), F.lit("")), r"^\[|\]$", "")
        return F.filter(F.transform(F.split(bare, "[,;]"), lambda x: F.trim(x)), lambda x: x != "")

    known = ("id", "title", "status", "tags", "related")
    extra = F.map_from_entries(F.collect_set(F.when(~F.col("k").isin(*known) & (F.col("k") != ""), F.struct("k", "v"))))
    return rows.dropDuplicates(["file_path", "k"]).groupBy("file_path").agg(one("id").alias("id"), one("title").alias("title"), one("status").alias("status"), many("tags").alias("tags"), many("related").alias("related"), extra.alias("extra"))


def sections(files: DataFrame, fence_aware: bool = False) -> DataFrame:
    """doc_source rows: a section for each heading, and one of level 0 for what stands before the first.

    A heading that another follows at once is dropped unless it is the last; the opening section always stands.
    """
    meta = front_matter(files).select("file_path", "title", "tags")
    lines_ = file_lines(files)
    by = Window.partitionBy("file_path").orderBy("line")
    upto = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # The front matter's lines are no content.
    fence = (F.trim("text") == "---").cast("int")
    starts = F.first("text").over(upto) == "---"
    lines_ = lines_.withColumn("_rule", F.sum(fence).over(upto)).withColumn("_meta", starts & ((F.col("_rule") < 2) | ((F.col("_rule") == 2) & (fence == 1))))
    lines_ = lines_.filter(~F.col("_meta")).drop("_rule", "_meta")
    is_heading = F.col("text").rlike(HEADING)
    if fence_aware:
        lines_ = lines_.withColumn("_ticks", F.sum(F.col("text").rlike("^\\s*```").cast("int")).over(upto))
        is_heading = is_heading & (F.col("_ticks") % 2 == 0)
    lines_ = lines_.withColumn("_h", is_heading).withColumn("_sec", F.sum(F.col("_h").cast("int")).over(upto))
    body = F.array_sort(F.collect_list(F.when(~F.col("_h"), F.struct("line", "text"))))
    s = lines_.groupBy("file_path", "_sec").agg(
        F.max(F.when(F.col("_h"), F.col("text"))).alias("_head"),
        F.min("line").alias("start_line"),
        F.max("line").alias("end_line"),
        F.array_join(body["text"], "\n").alias("content"),
        F.count(F.when(~F.col("_h"), 1)).alias("_body"),
    )
    # A file that begins with a heading has an empty opening section too.
    empty = files.select("file_path", F.lit(0).cast("long").alias("_sec")).join(s.filter("_sec = 0").select("file_path"), "file_path", "left_anti")
    s = s.unionByName(empty, allowMissingColumns=True).fillna({"content": "", "start_line": 1, "end_line": 1, "_body": 0})
    last = F.max("_sec").over(Window.partitionBy("file_path"))
    s = s.withColumn("_last", last).filter((F.col("_sec") == 0) | (F.col("_body") > 0) | (F.col("_sec") == F.col("_last")))
    s = s.join(meta, "file_path", "left")
    level = F.when(F.col("_sec") == 0, 0).otherwise(F.length(F.regexp_extract("_head", HEADING, 1)))
    heading = F.when(F.col("_sec") == 0, F.coalesce(F.when(F.col("title") != "", F.col("title")), F.lit("(intro)"))).otherwise(F.trim(F.regexp_extract("_head", HEADING, 2)))
    s = s.withColumn("level", level.cast("int")).withColumn("heading", heading)
    s = with_heading_path(s, "file_path", "_sec")
    s = s.withColumn("content", F.trim("content")).withColumn("summary", X.summary_line("content")).withColumn("out_links", raw_links("content"))
    order = F.dense_rank().over(Window.partitionBy("file_path").orderBy("_sec")).cast("long")
    return s.select(
        chunk_id(F.col("file_path"), F.col("heading"), F.col("start_line")).alias("chunk_id"),
        order.alias("ord"), "file_path", "heading", "heading_path", "level",
        F.col("start_line").cast("int"), F.col("end_line").cast("int"), "content", "summary",
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), "out_links",
    )


def with_heading_path(rows: DataFrame, file: str, order: str, name: str = "heading_path") -> DataFrame:
    """Adds the headings above a section and its own: those before it that nothing of their level or less has closed since.

    The state of a row is the last heading of each level so far, so that a file of any number of headings takes linear time.
    """
    upto = Window.partitionBy(file).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = [f"_last{n}" for n in range(LEVELS)]
    rows = rows.withColumns({c: F.max(F.when(F.col("level") == n, F.struct(F.col(order).alias("at"), F.col("heading").alias("h")))).over(upto) for n, c in enumerate(at)})
    above = []
    for n, c in enumerate(at):
        stands = F.col("level") >= n
        for lower in at[:n]:
            stands = stands & (F.col(lower).isNull() | (F.col(lower)["at"] < F.col(c)["at"]))
        above.append(F.when(stands, F.col(c)["h"]))
    return rows.withColumn(name, F.array_join(F.array_compact(F.array(*above)), " > ")).drop(*at)


def raw_links(content: Column | str) -> Column:
    """Targets of links to .md files, then of [[wiki]] links, outside fenced code."""
    bare = F.regexp_replace(X.col(content), r"(?s)```.*?```", "")
    md = F.filter(F.regexp_extract_all(bare, F.lit(r"\[([^\]]*)\]\(([^)]+)\)"), F.lit(2)), lambda x: x.endswith(".md") & ~x.startswith("http") & ~x.startswith("#"))
    return F.concat(md, F.regexp_extract_all(bare, F.lit(r"\[\[([^\]|]+)(?:\|[^\]]*)?\]\]"), F.lit(1)))


def links(source: DataFrame, files: DataFrame) -> DataFrame:
    """doc_links: each section's links with their text and line; target_resolved is null where no file answers."""
    rows = source.select("file_path", "heading", "start_line", F.posexplode(F.split("content", "\n")).alias("_at", "_line"))
    by = Window.partitionBy("file_path", "heading", "start_line").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tick = F.col("_line").rlike("^\\s*```").cast("int")
    whole = Window.partitionBy("file_path", "heading", "start_line")
    # A fence that isn't closed in its section hides nothing.
    rows = rows.withColumns({"_ticks": F.sum(tick).over(by), "_all": F.sum(tick).over(whole)}).filter("_ticks % 2 = 0 or _ticks = _all")
    md = F.arrays_zip(F.regexp_extract_all("_line", F.lit(r"\[([^\]]*)\]\(([^)]+)\)"), F.lit(1)).alias("t"), F.regexp_extract_all("_line", F.lit(r"\[([^\]]*)\]\(([^)]+)\)"), F.lit(2)).alias("x"))
    wiki = F.transform(F.regexp_extract_all("_line", F.lit(r"\[\[([^\]|]+)(?:\|[^\]]*)?\]\]"), F.lit(1)), lambda x: F.struct(x.alias("t"), x.alias("x")))
    md = F.filter(F.transform(md, lambda m: F.struct(m["t"].alias("t"), m["x"].alias("x"))), lambda m: m["x"].endswith(".md") & ~m["x"].startswith("http") & ~m["x"].startswith("#"))
    rows = rows.select(F.col("file_path").alias("source_file"), F.col("heading").alias("source_heading"), (F.col("start_line") + F.col("_at") + 1).cast("int").alias("line"), F.explode(F.concat(md, wiki)).alias("m"))
    rows = rows.select("source_file", "source_heading", F.col("m.x").alias("target_path"), F.col("m.t").alias("link_text"), "line").withColumn("_id", F.monotonically_increasing_id())
    return resolve_links(rows.distinct(), files.select("file_path")).select("source_file", "source_heading", "target_path", "target_resolved", "link_text", "line")


def normalized_path(path: Column) -> Column:
    """A path without . and .. segments."""
    step = lambda acc, x: F.when((x == "") | (x == "."), acc).when((x == "..") & (F.size(acc) > 0), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def link_tries(rows: DataFrame) -> DataFrame:
    """Each link with the paths that are tried for it, in their order (_try, _path): beside the source, from the root, and both with .md added."""
    beside = F.concat_ws("/", X.directory("source_file"), "target_path")
    tries = F.array(beside, F.col("target_path"), F.concat(beside, F.lit(".md")), F.concat("target_path", F.lit(".md")))
    return rows.select("*", F.posexplode(F.transform(tries, normalized_path)).alias("_try", "_path"))


def resolve_links(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Adds target_resolved: the first of the paths that are tried which is a file. rows have an _id, which goes."""
    known = files.select(normalized_path(X.slashed("file_path")).alias("_path"), F.col("file_path").alias("_file")).distinct()
    tried = link_tries(rows).join(known, "_path", "left")
    return tried.groupBy(*rows.columns).agg(F.min(F.when(F.col("_file").isNotNull(), F.struct("_try", "_file")))["_file"].alias("target_resolved")).drop("_id")


def refreshed_links(links: DataFrame, files: DataFrame, came_or_went: DataFrame) -> DataFrame:
    """doc_links after files came or went (file_path): only links that are tried at the path of such a file are resolved anew."""
    rows = cut(links.withColumn("_id", F.monotonically_increasing_id()))
    moved = came_or_went.select(normalized_path(X.slashed("file_path")).alias("_path")).distinct()
    ids = link_tries(rows).join(moved, "_path", "left_semi").select("_id").distinct()
    again = resolve_links(rows.drop("target_resolved").join(ids, "_id", "left_semi"), files)
    return rows.join(ids, "_id", "left_anti").drop("_id").unionByName(again)


def doc_sections(source: DataFrame) -> DataFrame:
    """The index rows of sections, with word and link counts."""
    return source.select("chunk_id", "ord", "file_path", "heading", "heading_path", "level", "start_line", "end_line", "summary", "tags", F.size("out_links").alias("link_count"), X.word_count("content").alias("word_count"))


def embedding_text(path: Column, summary: Column) -> Column:
    return F.concat(F.lit("search_document: "), path, F.lit("\n"), F.coalesce(summary, F.lit("")))


def paragraphs(text: Column | str) -> Column:
    """Paragraphs over thirty characters that are neither fences nor tables."""
    parts = F.transform(F.split(X.col(text), "\r\n\r\n|\n\n"), lambda x: F.trim(x))
    return F.filter(parts, lambda x: (F.length(x) > 30) & ~x.startswith("```") & ~x.startswith("|"))

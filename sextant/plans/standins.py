"""Tables of an index, made from the driver's tables, and the same as SQL, for the queries that are held against an oracle.

Code: a part is an F# file, a supplier a Python file that imports the parts that it deals in; each is one chunk. Notes: a Markdown file
for each supplier names those parts. Documents: each document of the corpus is a section in the file lang/source/dN.md that links to the next
one of its folder, to the next number and, where its text is short, to a file that isn't there. Cases: a document for each part, whose path
and text come from short lists, so that every rule of the triage is met.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.schema import chunk_id


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Code --------------------------------------------------------------------------


def deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(s, p, back): which supplier deals in which part, and whether it ever came back."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p")).agg(F.max(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("back"))


def _name(letter: str, key: str) -> Column:
    return F.concat(F.lit(letter), F.col(key).cast("string"))


def _part(key: str = "p_partkey") -> Column:
    return F.concat(F.lit("lib/"), F.replace("p_brand", F.lit("#"), F.lit("")), F.lit("/"), _name("P", key), F.lit(".fs"))


def _supplier() -> Column:
    return F.concat(F.lit("src/"), F.col("n_name"), F.lit("/"), _name("S", "s_suppkey"), F.lit(".py"))


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))


def _joined(lines: Column) -> Column:
    """Lines collected as (number, text), one below the other."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(lines)), lambda x: x["line"]), "\n")


def code_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with their content; ord: parts by number, then suppliers."""
    d, p, s = deals(spark, sf_dir), table(spark, sf_dir, "part"), suppliers(spark, sf_dir)
    of_part = d.groupBy("p").agg(_joined(F.struct(F.col("s").alias("k"), _name("S", "s").alias("line"))).alias("lines"))
    kind = F.when(F.col("p_type") == "ECONOMY", "type").when(F.col("p_type") == "PROMO", "record").otherwise("let")
    text = F.concat_ws("\n", F.concat(F.lit("let "), _name("P", "p_partkey"), F.lit(" = "), F.col("p_name")), F.concat(F.lit("near P"), (F.col("p_partkey") - 1).cast("string")), "lines")
    parts = p.join(of_part, F.col("p_partkey") == F.col("p"), "left").select(
        F.col("p_partkey").alias("ord"), _part().alias("file_path"), F.concat(F.lit("Parts."), "p_type").alias("module"), _name("P", "p_partkey").alias("name"), kind.alias("kind"),
        F.lit(1).alias("start_line"), F.col("p_size").alias("end_line"), F.col("p_name").alias("summary"), F.col("p_type").alias("signature"), text.alias("content"),
    )
    called = F.when(F.col("back") == 1, F.concat(F.lit("Parts."), "p_type", F.lit("."), _name("P", "p"))).otherwise(_name("P", "p"))
    of_supplier = d.join(p, F.col("p") == F.col("p_partkey")).groupBy("s").agg(_joined(F.struct(F.col("p").alias("k"), called.alias("line"))).alias("lines"), F.count("*").cast("int").alias("n"), F.min("p_type").alias("least"))
    deal = s.join(of_supplier, F.col("s_suppkey") == F.col("s")).select(
        (F.lit(1_000_000_000) + F.col("s_suppkey")).alias("ord"), _supplier().alias("file_path"), F.concat(F.lit("Suppliers."), "n_name").alias("module"), _name("S", "s_suppkey").alias("name"), F.lit("type").alias("kind"),
        F.lit(1).alias("start_line"), F.col("n").alias("end_line"), F.concat(F.lit("deals in "), "least").alias("summary"), F.lit("class").alias("signature"), F.col("lines").alias("content"),
    )
    rows = parts.unionByName(deal)
    return rows.withColumn("chunk_id", chunk_id(F.col("file_path"), F.col("name"), F.col("start_line")))


def code_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers import their parts, a part its first supplier."""
    d, p, s = deals(spark, sf_dir), table(spark, sf_dir, "part"), suppliers(spark, sf_dir)
    out = d.join(p, F.col("p") == F.col("p_partkey")).join(s, F.col("s") == F.col("s_suppkey")).select(_supplier().alias("file_path"), F.concat(F.lit("Parts."), "p_type", F.lit("."), _name("P", "p")).alias("module"))
    first = d.groupBy("p").agg(F.min("s").alias("s")).join(p, F.col("p") == F.col("p_partkey")).join(s, F.col("s") == F.col("s_suppkey"))
    return out.union(first.select(_part().alias("file_path"), F.concat(F.lit("Suppliers."), "n_name", F.lit("."), _name("S", "s")).alias("module")))


def type_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, p, s = deals(spark, sf_dir), table(spark, sf_dir, "part"), suppliers(spark, sf_dir)
    rows = d.join(p, F.col("p") == F.col("p_partkey")).join(s, F.col("s") == F.col("s_suppkey")).groupBy(_supplier().alias("file_path"))
    return rows.agg(F.array_sort(F.collect_set("p_type")).alias("types"))


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Markdown file for each supplier: parts that it deals in by their file, those that came back by a file and a member that don't exist."""
    line = F.when(F.col("back") == 1, F.concat(F.lit("lost `Q"), F.col("p").cast("string"), F.lit(".fs` of Lost.Thing"))).otherwise(F.concat(F.lit("see `P"), F.col("p").cast("string"), F.lit(".fs` of Parts.Economy")))
    rows = deals(spark, sf_dir).groupBy("s").agg(_joined(F.struct(F.col("p").alias("k"), line.alias("line"))).alias("content"))
    path = F.concat(F.lit("notes/"), _name("S", "s"), F.lit(".md"))
    return rows.select(F.col("s").alias("ord"), path.alias("file_path"), F.lit("Notes").alias("heading"), F.lit("Notes").alias("heading_path"), F.lit(1).alias("level"), F.lit(1).alias("start_line"), "content", chunk_id(path, F.lit("Notes"), F.lit(1)).alias("chunk_id"))


CODE = """deals AS (SELECT l_suppkey AS s, l_partkey AS p, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS back FROM lineitem GROUP BY 1, 2),
 parts AS (SELECT p_partkey AS p, 'lib/' || replace(p_brand, '#', '') || '/P' || p_partkey || '.fs' AS file_path, * FROM part),
 sups AS (SELECT s_suppkey AS s, 'src/' || n_name || '/S' || s_suppkey || '.py' AS file_path, * FROM supplier JOIN nation ON s_nationkey = n_nationkey),
 chunks AS (SELECT p AS ord, file_path, 'Parts.' || p_type AS module, 'P' || p AS name, CASE p_type WHEN 'ECONOMY' THEN 'type' WHEN 'PROMO' THEN 'record' ELSE 'let' END AS kind, 1 AS start_line, p_size AS end_line, p_name AS summary,
   'let P' || p || ' = ' || p_name || chr(10) || 'near P' || (p - 1) || coalesce(chr(10) || (SELECT string_agg('S' || d.s, chr(10) ORDER BY d.s) FROM deals d WHERE d.p = parts.p), '') AS content FROM parts
  UNION ALL SELECT 1000000000 + s, any_value(sups.file_path), 'Suppliers.' || any_value(n_name), 'S' || s, 'type', 1, count(*)::INT, 'deals in ' || min(p_type),
   string_agg(CASE WHEN back = 1 THEN 'Parts.' || p_type || '.P' || p ELSE 'P' || p END, chr(10) ORDER BY p) FROM deals JOIN parts USING (p) JOIN sups USING (s) GROUP BY s),
 imports AS (SELECT sups.file_path, 'Parts.' || p_type || '.P' || p AS module FROM deals JOIN parts USING (p) JOIN sups USING (s)
  UNION ALL SELECT parts.file_path, 'Suppliers.' || n_name || '.S' || f.s FROM (SELECT p, min(s) AS s FROM deals GROUP BY 1) f JOIN parts USING (p) JOIN sups ON sups.s = f.s),
 edges AS (SELECT sups.file_path AS src, parts.file_path AS dst FROM deals JOIN parts USING (p) JOIN sups USING (s)
  UNION ALL SELECT parts.file_path, sups.file_path FROM (SELECT p, min(s) AS s FROM deals GROUP BY 1) f JOIN parts USING (p) JOIN sups ON sups.s = f.s),
 notes AS (SELECT s, 'notes/S' || s || '.md' AS file_path, string_agg(CASE WHEN back = 1 THEN 'lost `Q' || p || '.fs` of Lost.Thing' ELSE 'see `P' || p || '.fs` of Parts.Economy' END, chr(10) ORDER BY p) AS content FROM deals GROUP BY s)"""

# Documents ---------------------------------------------------------------------


def path() -> Column:
    return F.concat_ws("/", "lang", "source", F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".md")))


SQL_PATH = "concat_ws('/', lang, source, 'd' || doc_id || '.md')"


def doc_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a section of level 1."""
    d = table(spark, sf_dir, "documents").withColumn("file_path", path())
    return d.select(
        F.col("doc_id").alias("ord"), "file_path", F.col("source").alias("heading"), F.concat_ws(" > ", "lang", "source").alias("heading_path"), F.lit(1).alias("level"), F.lit(1).alias("start_line"),
        F.size(F.split("text", "\n")).alias("end_line"), F.col("text").alias("content"), F.substring("text", 1, 20).alias("summary"), F.array("lang", "source").alias("tags"), F.lit(2).alias("link_count"),
        F.col("n_chars").cast("int").alias("word_count"), chunk_id(F.col("file_path"), F.col("source"), F.lit(1)).alias("chunk_id"), "doc_id", "lang", "source",
    )


def raw_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links as written: line 1 to the next document of the folder, beside it; line 2 to the next number, by its path without ending; line 3, where a
    document has under 500 characters, to a file that isn't there."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars", path().alias("p"))
    # The next one of the folder: the least larger number, by folder; folders are split no further, as each is one window of narrow rows.
    from pyspark.sql import Window

    nxt = d.withColumn("n", F.lead("doc_id").over(Window.partitionBy("lang", "source").orderBy("doc_id"))).filter("n is not null")
    beside = nxt.select(F.col("p").alias("source_file"), F.col("source").alias("source_heading"), F.concat(F.lit("d"), F.col("n").cast("string"), F.lit(".md")).alias("target_path"), F.lit("next").alias("link_text"), F.lit(1).alias("line"))
    other = d.select((F.col("doc_id") - 1).alias("b"), F.regexp_replace("p", r"\.md$", "").alias("t"))
    after = d.join(other, F.col("doc_id") == F.col("b")).select(F.col("p"), "source", "t", F.lit("after"), F.lit(2))
    gone = d.filter("n_chars < 500").select("p", "source", F.concat(F.lit("gone"), F.col("doc_id").cast("string"), F.lit(".md")), F.lit("gone"), F.lit(3))
    return beside.union(after).union(gone)


def doc_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, resolved by the operator."""
    from sextant.operators.markdown import resolve_links

    rows = raw_links(spark, sf_dir).withColumn("_id", F.monotonically_increasing_id())
    return resolve_links(rows, table(spark, sf_dir, "documents").select(path().alias("file_path")))


def frontmatters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of labelled documents: title, status by quality, tags; related: the file of the next number."""
    d = table(spark, sf_dir, "documents").select("doc_id", path().alias("file_path"), "lang")
    rows = d.join(table(spark, sf_dir, "labels"), "doc_id")
    return rows.select("file_path", F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("Title "), F.col("doc_id").cast("string")).alias("title"), F.when(F.col("quality") == 1, "final").otherwise("draft").alias("status"), F.array("lang", F.concat(F.lit("q"), F.col("quality").cast("string"))).alias("tags"), F.array(F.concat(F.lit("d"), (F.col("doc_id") + 1).cast("string"), F.lit(".md"))).alias("related"))


DOCS = f"""docs AS (SELECT *, {SQL_PATH} AS file_path FROM documents),
 links AS (SELECT file_path AS source_file, source AS source_heading, 'd' || n || '.md' AS target_path, concat_ws('/', lang, source, 'd' || n || '.md') AS target_resolved, 'next' AS link_text, 1 AS line
   FROM (SELECT *, lead(doc_id) OVER (PARTITION BY lang, source ORDER BY doc_id) AS n FROM docs) WHERE n IS NOT NULL
  UNION ALL SELECT a.file_path, a.source, regexp_replace(b.file_path, '\\.md$', ''), b.file_path, 'after', 2 FROM docs a JOIN docs b ON b.doc_id = a.doc_id + 1
  UNION ALL SELECT file_path, source, 'gone' || doc_id || '.md', NULL, 'gone', 3 FROM docs WHERE n_chars < 500),
 meta AS (SELECT d.file_path, 'Title ' || d.doc_id AS title, CASE WHEN quality = 1 THEN 'final' ELSE 'draft' END AS status, lang || ', q' || quality AS tags, 'd' || (d.doc_id + 1) || '.md' AS related FROM docs d JOIN labels USING (doc_id))"""

"""The code index: chunks (as code_chunks, with content where the text is asked for), imports and type references."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.functions import text as X
from sextant.operators import contain, graph, scan
from sextant.operators.scan import changed, explain_match, grep, search, similar  # noqa: F401
from sextant.plans.storage import cut


def context(chunks: DataFrame, imports: DataFrame, file: str) -> DataFrame:
    """A row for the file that answers to a name: chunks, imports, files that import it; `error` where several do."""
    rows = chunks.filter(X.match_file("file_path", file))
    per = rows.groupBy("file_path").agg(F.array_sort(F.collect_list(F.struct("start_line", "ord", "chunk_id", "kind", "name", "end_line", "signature", "summary"))).alias("chunks"))
    per = per.join(imports.groupBy("file_path").agg(F.collect_list("module").alias("imports")), "file_path", "left")
    stem = file.replace("\\", "/").rsplit("/", 1)[-1].rsplit(".", 1)[0]
    dependents = imports.filter(X.icontains("module", stem)).agg(F.array_sort(F.collect_set(X.file_name("file_path"))).alias("dependents"))
    many = per.agg(F.count("*").alias("_n"), F.array_join(F.array_sort(F.collect_list("file_path")), ", ").alias("_all"))
    # One row on either side: what a name answers to, counted.
    out = per.join(F.broadcast(many), F.lit(True)).join(F.broadcast(dependents), F.lit(True))
    return out.withColumn("error", F.when(F.col("_n") > 1, F.concat(F.lit("several files answer: "), "_all"))).drop("_n", "_all")


def impact(type_refs: DataFrame, chunks: DataFrame, name: str) -> DataFrame:
    """Files that refer to a type, each with its first chunk whose name or summary holds it."""
    files = type_refs.filter(F.array_contains("types", name)).select("file_path").distinct()
    hit = chunks.filter(X.icontains("summary", name) | X.icontains("name", name)).groupBy("file_path").agg(F.min_by(F.struct("chunk_id", "summary"), "ord").alias("c"))
    return files.join(hit, "file_path", "left").select("file_path", "c.chunk_id", "c.summary")


def imports_of(imports: DataFrame, file: str) -> DataFrame:
    return imports.filter(X.match_file("file_path", file)).select("module")


def dependents_of(imports: DataFrame, pattern: str) -> DataFrame:
    """Names of the files that import a module whose name holds a text."""
    return imports.filter(X.icontains("module", pattern)).select(X.file_name("file_path").alias("file")).distinct()


def expand(chunks: DataFrame, source: DataFrame, chunk: str, imports: DataFrame | None = None) -> DataFrame:
    """A chunk with its code; with imports, also what its file imports and the files that import a module which holds its file's stem."""
    out = chunks.filter(F.col("chunk_id") == chunk).join(source.select("chunk_id", F.col("content").alias("code")), "chunk_id", "left")
    out = out.withColumn("code", F.coalesce("code", F.lit("(source not loaded)")))
    if imports is None:
        return out
    one = out.select("chunk_id", F.col("file_path").alias("_path"), F.lower(X.file_stem("file_path")).alias("_stem"))  # one row
    own = imports.join(F.broadcast(one), F.col("file_path") == F.col("_path")).groupBy("chunk_id").agg(F.array_sort(F.collect_list("module")).alias("imports"))
    users = imports.join(F.broadcast(one), F.contains(F.lower("module"), F.col("_stem"))).groupBy("chunk_id").agg(F.array_sort(F.collect_set(X.file_name("file_path"))).alias("dependents"))
    out = out.join(own, "chunk_id", "left").join(users, "chunk_id", "left")
    none = F.array().cast("array<string>")
    return out.withColumns({c: F.coalesce(c, none) for c in ("imports", "dependents")})


#: The most chunks on either side of one that the code index shows.
BESIDE = 5


def neighborhood(chunks: DataFrame, chunk: str, before: int = 3, after: int = 3) -> DataFrame:
    """A chunk's file around it, five chunks each way at most."""
    return scan.neighborhood(chunks, chunk, min(before, BESIDE), min(after, BESIDE))


def files(chunks: DataFrame, imports: DataFrame, pattern: str | None = None) -> DataFrame:
    """By file: chunks, kinds, imports; in the order of their names."""
    rows = scan.grouped_files(chunks, pattern).groupBy("file_path").agg(F.count("*").alias("chunks"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))
    n = imports.groupBy("file_path").agg(F.count("*").alias("imports"))
    return rows.join(n, "file_path", "left").fillna(0, ["imports"]).withColumn("file", X.file_name("file_path"))


def module_bucket(path: Column | str, src_dirs: tuple[str, ...] = ("src", "lib", "Source", "app")) -> Column:
    """The segment after a source folder; else the top folder, those with tests under tests/; else other."""
    p = X.slashed(path)
    top = F.regexp_extract(p, "^([^/]+)/", 1)
    after = F.regexp_extract(p, "(?:^|/)(?:" + "|".join(src_dirs) + ")/([^/]+)/", 1)
    return F.when(after != "", after).when(top == "", "other").when(F.lower(p).contains("test"), F.concat(F.lit("tests/"), top)).otherwise(top)


def modules(chunks: DataFrame, src_dirs: tuple[str, ...] = ("src", "lib", "Source", "app")) -> DataFrame:
    rows = chunks.withColumn("module", module_bucket("file_path", src_dirs)).withColumn("file", X.file_name("file_path"))
    return rows.groupBy("module").agg(
        F.countDistinct("file_path").alias("files"),
        F.count("*").alias("chunks"),
        F.array_join(F.array_sort(F.collect_set("file")), ", ").alias("file_list"),
        scan.first_distinct("name", 8, F.col("kind").isin("type", "record", "du")).alias("top_types"),
        scan.first_distinct("summary", 3, F.col("summary") != "", " | ").alias("summaries"),
    )


def refs(chunks: DataFrame, name: str, limit: int | None = 20) -> DataFrame:
    """Chunks whose text holds a name as a word, other than the one of that name."""
    p = X.word_pattern(name)
    return scan.first(chunks.filter(F.col("content").rlike(p) & (F.col("name") != name)), limit).withColumn("match_line", X.match_line("content", p))


def callers(chunks: DataFrame, qualified: str, limit: int | None = 20) -> DataFrame:
    """Callers of A.b: qualified where A.b stands, local where b stands within A; the definition itself aside."""
    owner, _, short = qualified.rpartition(".")
    whole, own = X.word_pattern(qualified), X.word_pattern(short)
    local = (F.col("module") == owner) | F.col("name").startswith(owner + ".") if owner else F.lit(True)
    how = F.when(F.col("content").rlike(whole), "qualified").when(local & F.col("content").rlike(own), "local")
    rows = chunks.withColumn("call_type", how).filter(F.col("call_type").isNotNull() & ~F.col("name").isin(qualified, short))
    lines = F.when(F.col("call_type") == "qualified", X.match_lines("content", whole)).otherwise(X.match_lines("content", own))
    return scan.first(rows, limit).withColumn("match_line", lines)


def short_name(name: Column | str) -> Column:
    return F.substring_index(X.col(name), ".", -1)


def walk(chunks: DataFrame, name: str, depth: int = 2, limit: int = 5) -> DataFrame:
    """References of references, depth first: (at, hop, chunk_id, name, file, line, match_line, trail), 3 * depth * limit rows at most.

    The first `limit` chunks that hold a name as a word, other than those of that name, are its references; from each, the last segment of its name
    is looked for next, if it is longer than two letters and no part of a split chunk. Each hop is one pass over the chunks, whose words are
    looked up among those of the frontier where they are: it has limit ** hop names at most and goes to all tasks.
    """
    spark = chunks.sparkSession
    file = F.concat(F.lit(" ("), X.file_name("file_path"), F.lit(":"), F.col("start_line").cast("string"), F.lit(")"))
    goes_on = (F.length(short_name("name")) > 2) & ~F.contains(short_name("name"), F.lit("_part"))

    def hop(frontier: DataFrame, k: int) -> DataFrame:
        wanted = F.broadcast(cut(frontier.select("src", contain.key_run("src").alias("word"))))
        asked = F.broadcast(wanted.agg(F.collect_set("word").alias("asked")))  # one row
        hits = chunks.select("chunk_id", "ord", "name", "file_path", "start_line", "content").join(asked, F.lit(True)).withColumn("found", F.array_intersect(contain.runs("content"), "asked"))
        hits = hits.filter(F.size("found") > 0).drop("asked").withColumn("word", F.explode("found")).drop("found").join(wanted, "word").filter(F.col("name") != F.col("src"))
        # A name of several words is verified where its longest word stands.
        hits = hits.filter(F.col("src").rlike(r"(?U)^\w+$") | F.regexp_like("content", contain.word_pattern("src")))
        rows = graph.first_of(hits.withColumnRenamed("chunk_id", "dst"), limit)
        line = F.trim(F.get(F.filter(X.lines("content"), lambda x: F.regexp_like(x, contain.word_pattern("src"))), F.lit(0)))
        return rows.select("src", "ord", "dst", F.when(goes_on, short_name("name")).alias("next"), F.concat("name", file).alias("said"), "name", X.file_name("file_path").alias("file"), F.col("start_line").alias("line"), F.coalesce(line, F.lit("")).alias("match_line"))

    start = spark.createDataFrame([(name,)], "src string")
    edges = graph.reached(start, depth, hop)
    rows = graph.depth_first(edges, start.withColumn("said", F.col("src")), depth, 3 * depth * limit, unseen=False).filter("dst is not null")
    return rows.join(edges.select("src", "dst", "name", "file", "line", "match_line"), ["src", "dst"]).select("at", "hop", F.col("dst").alias("chunk_id"), "name", "file", "line", "match_line", "trail")


def named_files(chunks: DataFrame) -> DataFrame:
    """(file, stem): the names of files; stems of three letters or more are what an import is matched with."""
    return chunks.select(X.file_name("file_path").alias("file")).distinct().withColumn("stem", F.lower(X.file_stem("file")))


def import_edges(chunks: DataFrame, imports: DataFrame) -> DataFrame:
    """(src, dst) between the names of files, once: src imports a module that holds dst's stem anywhere, case aside."""
    names = named_files(chunks)
    said = imports.select(X.file_name("file_path").alias("src"), F.lower("module").alias("text")).distinct()
    hits = contain.held(said.select("text"), names.select(F.col("stem").alias("part")))
    return said.join(hits, "text").join(names.select(F.col("file").alias("dst"), F.col("stem").alias("part")), "part").filter("src <> dst").select("src", "dst").distinct()


def import_hop(chunks: DataFrame, imports: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """The edges of import_edges, in either direction, of the files (src) that are asked for: (src, dst). By way of the modules, as
    a module stands once for all files that import it and a stem once for all modules that hold it; all edges are never made."""
    names = named_files(chunks)
    said = cut(imports.select(X.file_name("file_path").alias("src"), F.lower("module").alias("text")))
    hits = contain.held(said.select("text"), names.select(F.col("stem").alias("part")))
    met = cut(hits.join(names.select(F.col("file").alias("dst"), F.col("stem").alias("part")), "part").select("text", "dst"))

    def hop(files: DataFrame) -> DataFrame:
        files = graph.small(files)
        out = said.join(files, "src").join(met, "text").select("src", "dst")
        held = met.withColumnRenamed("dst", "src").join(files, "src")
        into = said.withColumnRenamed("src", "dst").join(graph.small(held), "text").select("src", "dst")
        return out.union(into).filter("src <> dst")

    return hop


def fan_in(chunks: DataFrame, imports: DataFrame, compat: bool = False) -> DataFrame:
    """(file, fan_in): how many imports of other files hold a file's stem; compat: 2 n - 1 for n, as an old counter had it.

    Modules are counted before they are matched, so that one which a third of all files import is one row; a file's own imports are taken off."""
    names = named_files(chunks)
    n = cut(imports.groupBy(F.lower("module").alias("text")).agg(F.count("*").alias("n")))
    stem = F.lower(X.file_stem("file_path"))
    own = imports.filter((F.length(stem) >= contain.GRAM) & F.contains(F.lower("module"), stem)).groupBy(X.file_name("file_path").alias("file")).agg(F.count("*").alias("own"))
    hits = contain.held(n.select("text"), names.select(F.col("stem").alias("part"))).join(n, "text").groupBy("part").agg(F.sum("n").alias("n"))
    out = names.join(hits, F.col("stem") == F.col("part")).join(own, "file", "left").select("file", (F.col("n") - F.coalesce("own", F.lit(0))).alias("fan_in")).filter("fan_in > 0")
    return out.withColumn("fan_in", 2 * F.col("fan_in") - 1) if compat else out


def hotspots(chunks: DataFrame, imports: DataFrame, by: str = "chunks", least: int = 1, compat: bool = False) -> DataFrame:
    """By file of at least `least` chunks: chunks, lines of code, imports of it by others and its own, the most of `by` first."""
    rows = chunks.groupBy("file_path").agg(F.count("*").alias("chunks"), F.sum(F.col("end_line") - F.col("start_line") + 1).cast("long").alias("loc"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))
    rows = rows.filter(F.col("chunks") >= least).withColumn("file", X.file_name("file_path"))
    out = imports.groupBy("file_path").agg(F.count("*").alias("fan_out"))
    rows = rows.join(fan_in(chunks, imports, compat), "file", "left").join(out, "file_path", "left").fillna(0, ["fan_in", "fan_out"])
    return rows.select("file_path", "chunks", "loc", "kinds", "fan_in", "fan_out").orderBy(F.desc(by), "file_path")


def resolved_file(chunks: DataFrame, text: str) -> str | None:
    """The name of the first file, in the index's order, whose name holds a text, case aside."""
    hit = chunks.filter(X.icontains(X.file_name("file_path"), text)).orderBy("ord").limit(1).select(X.file_name("file_path").alias("f")).first()
    return hit.f if hit else None


def trace(chunks: DataFrame, imports: DataFrame, start: str, goal: str) -> DataFrame:
    """The shortest way between two files over imports in either direction: (step, node, length, error), a row for each file, length in edges;
    one row with the error where a text names no file or there is no way."""
    spark = chunks.sparkSession
    found = {t: resolved_file(chunks, t) for t in (start, goal)}

    def error(text: str) -> DataFrame:
        return spark.createDataFrame([(None, None, None, text)], "step int, node string, length int, error string")

    for t, f in found.items():
        if f is None:
            return error(f"could not resolve '{t}' to a file")
    a, b = found[start], found[goal]
    path = cut(graph.shortest_way(spark, import_hop(chunks, imports), a, b))
    if path.isEmpty():
        return error(f"no path from '{a}' to '{b}'")
    return path.select("step", "node", (F.max("step").over(Window.partitionBy(F.lit(1))) - 1).alias("length"), F.lit(None).cast("string").alias("error"))

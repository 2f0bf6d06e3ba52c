"""Between the two indexes: what documents name that code doesn't have, and code that no document names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.functions import text as X
from sextant.operators.code import fan_in
from sextant.operators.contain import standing
from sextant.operators.scan import first_distinct
from sextant.plans.storage import cut

# What is read as a code file, and as a qualified member; words have letters of any script.
FILE_TOKEN = r"(?U)\b(\w[\w.-]*\.(?:fs|fsx|cs|ts|tsx|js|jsx|py|go|rs|java|kt))\b"
MEMBER_TOKEN = r"(?U)\b([A-Z]\w+\.\w{3,})\b"


#: What a token of a document is looked up as.
FILE, MODULE, MEMBER = 0, 1, 2


def symbols(chunks: DataFrame) -> DataFrame:
    """(symbol, chunk_id): each chunk under its name, module and name, file name and stem, lower-cased; of three letters or more."""
    whole = F.when((F.col("module") != "") & (F.col("name") != ""), F.concat_ws(".", "module", "name"))
    names = F.array("name", whole, X.file_name("file_path"), X.file_stem("file_path"))
    return chunks.select("chunk_id", F.explode(F.array_distinct(F.transform(names, lambda x: F.lower(x)))).alias("symbol")).filter(F.length("symbol") >= 3)


def drift(sections: DataFrame, chunks: DataFrame) -> DataFrame:
    """Sections (file_path, heading, content, chunk_id) with the files and members that they name and the code lacks, as they come.

    A member is missing if neither its module (a chunk's name, or a .fs or .cs file) nor itself (a chunk's name) is there. Each section's text is
    read once; its distinct tokens are looked up by one join on equality."""
    # What the code has, a row each: files, what a member may stand under, and what it may be. A chunk's names alone are read.
    code = chunks.select(F.lower(X.file_name("file_path")).alias("file"), F.when(F.length("name") >= 3, F.lower("name")).alias("name"))
    stem = F.when(F.col("file").rlike(r"\.(fs|cs)$"), F.regexp_replace("file", r"\.(fs|cs)$", ""))
    has = lambda role, s: F.struct(F.lit(role).alias("role"), s.alias("s"))
    known = code.select(F.explode(F.array(has(FILE, F.col("file")), has(MODULE, stem), has(MODULE, F.col("name")), has(MEMBER, F.col("name")))).alias("x")).select("x.*").filter("s is not null").distinct()
    base = sections.select("chunk_id", "file_path", "heading", "content")
    tokens = lambda pattern: F.array_distinct(F.regexp_extract_all("content", F.lit(pattern), F.lit(1)))
    members = F.filter(tokens(MEMBER_TOKEN), lambda x: F.size(F.split(x, r"\.")) == 2)
    looked = lambda x, i, role, s: F.struct(F.lit(role).alias("role"), F.lower(s).alias("s"), i.alias("at"), x.alias("token"))
    said = base.select("chunk_id", "file_path", "heading", F.explode(F.concat(
        F.transform(tokens(FILE_TOKEN), lambda x, i: looked(x, i, FILE, x)),
        F.transform(members, lambda x, i: looked(x, i, MODULE, F.substring_index(x, ".", 1))),
        F.transform(members, lambda x, i: looked(x, i, MEMBER, F.substring_index(x, ".", -1))),
    )).alias("x")).select("chunk_id", "file_path", "heading", "x.*")
    lost = said.join(known, ["role", "s"], "left_anti")
    # A file is missing if it isn't there, a member if neither its module nor itself is.
    by = lost.groupBy("chunk_id", "file_path", "heading").agg(F.array_sort(F.collect_list(F.struct(F.least("role", F.lit(MODULE)).alias("kind"), "at", "role", "token"))).alias("x"))
    pair = F.filter("x", lambda x, i: (x["role"] == FILE) | ((x["role"] == MEMBER) & (i > 0) & (F.get("x", i - 1)["role"] == MODULE) & (F.get("x", i - 1)["at"] == x["at"])))
    found = by.select("chunk_id", "file_path", "heading", F.array_distinct(F.transform(pair, lambda x: x["token"])).alias("tokens")).filter(F.size("tokens") > 0)
    return found.select("chunk_id", "file_path", "heading", F.array_join("tokens", ", ").alias("missing_symbols"), F.size("tokens").alias("count"))


def coverage(chunks: DataFrame, imports: DataFrame, docs: DataFrame, min_fan_in: int = 2) -> DataFrame:
    """Files, by name, that others import at least so often and no document names: neither the stem (of three letters or more) nor the
    whole name stands between word borders, case aside. Those imported most come first."""
    f = cut(fan_in(chunks, imports).filter(F.col("fan_in") >= min_fan_in))  # asked for several times
    names = f.select("file", F.explode(F.array_distinct(F.array(F.lower("file"), F.when(F.length(X.file_stem("file")) >= 3, F.lower(X.file_stem("file"))).otherwise(F.lower("file"))))).alias("name"))
    told = names.join(standing(names, docs.select(F.lower("content").alias("content"))), "name", "left_semi").select("file").distinct()
    f = f.join(told, "file", "left_anti")
    rows = chunks.withColumn("file", X.file_name("file_path")).join(f.select("file"), "file", "left_semi").groupBy("file").agg(
        F.min_by("file_path", "ord").alias("file_path"), F.count("*").alias("chunks"), F.sum(F.col("end_line") - F.col("start_line") + 1).cast("long").alias("loc"),
        F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"), first_distinct("name", 5).alias("top_symbols"),
    )
    return rows.join(f, "file").select("file_path", "fan_in", "chunks", "loc", "kinds", "top_symbols").orderBy(F.desc("fan_in"), "file_path")

"""Primitives that both indexes share: filters in table order, windows around a row, vector search, groupings.

Tables carry `ord`; "the first n" is orderBy(ord).limit(n), which Spark runs as a bounded heap in each task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.functions import text as X
from sextant.functions import vectors as V


def first(df: DataFrame, n: int | None) -> DataFrame:
    return df if n is None else df.orderBy("ord").limit(n)


def grep(df: DataFrame, pattern: str, limit: int | None = 10, kind: str | None = None, file: str | None = None) -> DataFrame:
    """Rows whose content matches, with the first line that does."""
    p = X.safe_pattern(pattern)
    out = df.filter(F.col("content").rlike(p))
    if kind is not None:
        out = out.filter(F.col("kind") == kind)
    if file is not None:
        out = out.filter(X.icontains("file_path", file))
    return first(out, limit).withColumn("match_line", X.match_line("content", p))


def mentions(df: DataFrame, term: str, limit: int | None = 20) -> DataFrame:
    """Rows that hold a word, case aside, with how often and the first line that does."""
    p = X.word_pattern(term, ignore_case=True)
    # Neighbours share a border, so the count looks ahead for the closing one.
    ahead = p.rsplit("(", 1)[0] + "(?=" + p.rsplit("(", 1)[1]
    out = first(df.filter(F.col("content").rlike(p)), limit)
    return out.withColumn("match_line", X.match_line("content", p)).withColumn("count", F.regexp_count("content", F.lit(ahead)))


def neighborhood(df: DataFrame, chunk: str, before: int = 3, after: int = 3, by: str = "start_line") -> DataFrame:
    """A row's file around it: each row with its distance; 0 is the row itself. The file is found first, so one file is sorted."""
    target = df.filter(F.col("chunk_id") == chunk).orderBy("ord").limit(1).select(F.col("file_path").alias("_f"))
    rows = df.join(F.broadcast(target), F.col("file_path") == F.col("_f"), "left_semi")
    w = Window.partitionBy("file_path")
    rows = rows.withColumn("_n", F.row_number().over(w.orderBy(by, "ord")))
    rows = rows.withColumn("distance", F.col("_n") - F.min(F.when(F.col("chunk_id") == chunk, F.col("_n"))).over(w))
    return rows.filter(F.col("distance").between(-before, after)).drop("_n")


def all_neighborhoods(df: DataFrame, wanted: DataFrame, before: int = 3, after: int = 3, by: str = "start_line") -> DataFrame:
    """neighborhood() of many rows at once; wanted (chunk_id)."""
    wanted = wanted.select("chunk_id").distinct()
    # Only files with a wanted row are numbered.
    some = df.join(df.join(wanted, "chunk_id", "left_semi").select("file_path").distinct(), "file_path", "left_semi")
    rows = some.withColumn("_n", F.row_number().over(Window.partitionBy("file_path").orderBy(by, "ord")))
    centre = rows.join(wanted, "chunk_id").select(F.col("chunk_id").alias("target"), F.col("file_path").alias("_f"), F.explode(F.sequence(F.col("_n") - before, F.col("_n") + after)).alias("_at"), F.col("_n").alias("_c"))
    out = centre.join(rows, (F.col("_f") == F.col("file_path")) & (F.col("_at") == F.col("_n")))
    return out.withColumn("distance", F.col("_n") - F.col("_c")).drop("_f", "_at", "_n", "_c")


def similar(df: DataFrame, vector: list[float], limit: int = 5, column: str = "emb", exclude: Column | None = None) -> DataFrame:
    """The rows nearest to a vector by cosine, with scores to three places."""
    rows = df if exclude is None else df.filter(~exclude)
    return V.top(V.scored(rows, column, vector).filter("score is not null"), limit).withColumn("score", X.rounded("score"))


def search(df: DataFrame, vector: list[float], limit: int = 5, column: str = "emb", where: Column | None = None, prefilter: bool = False) -> DataFrame:
    """Three times `limit` by cosine, then a filter, then `limit`; prefilter filters first and misses none."""
    if where is not None and prefilter:
        return similar(df.filter(where), vector, limit, column)
    rows = V.top(V.scored(df, column, vector), 3 * limit)
    rows = rows if where is None else rows.filter(where)
    return V.top(rows, limit).withColumn("score", X.rounded("score"))


def grouped_files(df: DataFrame, pattern: str | None = None, glob_on_name: bool = True) -> DataFrame:
    """Files whose name answers a glob, or whose name or path holds a text."""
    if pattern is None:
        return df
    if glob_on_name and any(c in pattern for c in "*?"):
        return df.filter(X.file_name("file_path").rlike(X.name_pattern(pattern)))
    return df.filter(X.icontains(X.file_name("file_path"), pattern) | X.icontains("file_path", pattern))


def first_distinct(value: str, k: int, when: Column | None = None, sep: str = ", ") -> Column:
    """The first k distinct values in the order of the table, joined. State: one entry for each distinct value."""
    v = F.col(value) if when is None else F.when(when, F.col(value))
    pairs = F.array_sort(F.collect_set(F.when(v.isNotNull(), F.struct("ord", v.alias("v")))))
    return F.array_join(F.slice(F.array_distinct(pairs["v"]), 1, k), sep)


def breakdown(df: DataFrame, k: int = 8) -> DataFrame:
    """The k directories (two levels) with most files."""
    two = F.array_join(F.slice(F.split(X.directory("file_path"), "/"), 1, 2), "/")
    return df.groupBy(two.alias("directory")).agg(F.countDistinct("file_path").alias("files")).orderBy(F.desc("files"), "directory").limit(k)


def dense_folders(df: DataFrame, least: int = 8) -> DataFrame:
    return df.groupBy(X.directory("file_path").alias("directory")).agg(F.countDistinct("file_path").alias("files")).filter(F.col("files") >= least)


def merge_by(key: str, *tables: DataFrame) -> DataFrame:
    """Rows of several tables, of each key the first (by table, then ord); rows without the key all stay."""
    out = None
    for k, t in enumerate(tables):
        t = t.withColumn("_table", F.lit(k))
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("_table", "ord")
    return out.withColumn("_k", F.row_number().over(w)).filter(F.col(key).isNull() | (F.col("_k") == 1)).drop("_k", "_table")


def pipe(value, *steps):
    """Applies functions from left to right."""
    for step in steps:
        value = step(value)
    return value


def tap(df: DataFrame, look) -> DataFrame:
    look(df)
    return df


def explain_match(chunks: DataFrame, source: DataFrame) -> DataFrame:
    """How each chunk finds its source: by id, by path, name and line, by path and name only, or not."""
    s = source.select(F.col("chunk_id").alias("_id")).distinct()
    t = source.select(F.col("file_path").alias("_p"), F.col("name").alias("_n"), F.col("start_line").alias("_l")).distinct()
    p = source.select(F.col("file_path").alias("_p2"), F.col("name").alias("_n2")).distinct()
    out = chunks.join(s, F.col("chunk_id") == F.col("_id"), "left")
    out = out.join(t, (F.col("file_path") == F.col("_p")) & (F.col("name") == F.col("_n")) & (F.col("start_line") == F.col("_l")), "left")
    out = out.join(p, (F.col("file_path") == F.col("_p2")) & (F.col("name") == F.col("_n2")), "left")
    how = F.when(F.col("_id").isNotNull(), "chunk_id").when(F.col("_p").isNotNull(), "path+name+line").when(F.col("_p2").isNotNull(), "partial").otherwise("none")
    return out.withColumn("source_match", how).drop("_id", "_p", "_n", "_l", "_p2", "_n2")


def changed(df: DataFrame, paths: DataFrame) -> DataFrame:
    """Rows of changed files; paths (file_path)."""
    return df.join(paths.select("file_path").distinct(), "file_path", "left_semi")


def hash_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(file_path, change) of file hashes: added, removed, modified or same."""
    both = old.select("file_path", F.col("sha256").alias("_a")).join(new.select("file_path", F.col("sha256").alias("_b")), "file_path", "full_outer")
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_a") == F.col("_b"), "same").otherwise("modified")
    return both.select("file_path", change.alias("change"))

"""Mixing sources to target weights (native): Efraimidis-Spirakis sampling.

Each row gets an exponential key, -ln(u) / quality, with u from a seeded hash. Within its source, rows are
taken in ascending key order until their sizes reach the source's token budget; a target above the source's
size is met by complete epochs first and a fractional selection after. The row that crosses the budget is taken
in part (its first words), so that every source meets its target.

Scale: the order within a source is never sorted in one task. Keys are turned into uniform ranks
v = 1 - exp(-key) and cut into BUCKETS ranges; sizes by (source, range) are pre-aggregated and prefix-summed
(at most BUCKETS rows a source), and rows are sorted only within (source, range). A source with a third of all
rows is thus spread over BUCKETS tasks.

Defined cases: a null text has size 0 and is never taken; a null source is a source of its own and the last;
equal rows count as often as they stand; a null doc_id is a row as any other. An empty table gives no rows.
Other columns pass through unchanged; the operator's own columns are named in `OUT` and replace columns of
that name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sextant.llm.common import SPACE, WORD, cut, n_words, read_table

BUCKETS = 1024
#: Up to so many sources, the table with a row for each is broadcast; beyond, it is joined by a shuffle.
SMALL = 50_000
OUT = ("size", "source_size", "target", "taken")


def quality_weight(text: Column, size: Column) -> Column:
    """A weight from 0.25 to 1 that rises with a text's length and falls as its mean word length leaves that of prose. A better judge of
    quality, such as a classifier's score, is passed to the operator as a column."""
    mean = F.length(text) / F.greatest(size, F.lit(1))
    return 0.25 + 0.75 * (size / (size + 20)) * F.exp(-F.abs(mean - 7) / 7)


def uniform(seed: int, *parts: Column) -> Column:
    """A number above 0 and below 1 from a hash of the parts."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *parts), 12).cast("double") + 0.5) / float(1 << 52)


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """sizes: (source, source_size), a row for each source. Adds target.

    Water filling in closed form: with sources sorted by most * size / weight, those up to some rank stand at
    their ceiling and the others share the rest by weight; the windows run over one row a source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    s = sizes.select("source", "source_size", w.alias("w")).withColumn("ceil", F.col("source_size") * F.lit(most))
    by_ratio = Window.orderBy(F.col("ceil") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("level", (F.sum("source_size").over(every) - F.coalesce(F.sum("ceil").over(before), F.lit(0.0))) / F.sum("w").over(rest))
    # The first source, by ratio, whose ceiling is above the shared level: from it on, all get level * weight.
    s = s.withColumn("at", F.min(F.when(F.col("level") * F.col("w") <= F.col("ceil"), F.struct(F.col("ceil") / F.col("w"), F.col("level")))).over(every)["level"])
    return s.select("source", "source_size", F.coalesce(F.least("ceil", F.col("at") * F.col("w")), "ceil").alias("target"))


def ranked(docs: DataFrame, seed: int = 17, quality: Column | None = None) -> DataFrame:
    """Adds size, the uniform rank _v (in the order of the exponential keys) and its range _b."""
    size = n_words(F.col("text"))
    weight = quality if quality is not None else quality_weight(F.col("text"), F.col("size"))
    out = docs.withColumn("size", size).withColumn("_w", F.greatest(F.coalesce(weight, F.lit(0.5)), F.lit(0.01)))
    # 1 - exp(-key) = 1 - u ** (1 / quality)
    out = out.withColumn("_v", 1 - F.pow(uniform(seed, F.col("doc_id"), F.crc32("text")), 1 / F.col("_w"))).drop("_w")
    return out.withColumn("_b", F.least(F.floor(F.col("_v") * BUCKETS), F.lit(BUCKETS - 1)).cast("int"))


def budgets(rows: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """A row for each source: its size, target, complete epochs, and the range in which its budget ends."""
    per = cut(rows.groupBy("source", "_b").agg(F.sum("size").alias("_n")))
    goal = targets(per.groupBy("source").agg(F.sum("_n").alias("source_size")), weights, most)
    goal = goal.withColumn("_epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    goal = goal.withColumn("_rest", F.round(F.col("target")).cast("long") - F.col("_epochs") * F.col("source_size"))
    upto = Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_before", F.coalesce(F.sum("_n").over(upto), F.lit(0))).withColumnRenamed("source", "_s")
    ends = per.join(goal, F.col("_s").eqNullSafe(F.col("source")))
    at = F.min(F.when(F.col("_rest") < F.col("_before") + F.col("_n"), F.struct("_b", "_before")))
    ends = ends.groupBy(F.col("source").alias("_s"), "source_size", "target", "_epochs", "_rest").agg(at.alias("_at"))
    return ends.select("_s", "source_size", "target", "_epochs", (F.col("_rest") - F.col("_at._before")).alias("_left"), F.coalesce("_at._b", F.lit(BUCKETS)).alias("_c"))


def take(rows: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """rows: as ranked() makes them. Adds source_size, target and taken; only the range in which a budget ends is sorted."""
    src = cut(budgets(rows, weights, most))
    src = F.broadcast(src) if src.count() <= SMALL else src
    rows = rows.join(src, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    run = F.sum("size").over(Window.partitionBy("source").orderBy("_v", "doc_id").rowsBetween(Window.unboundedPreceding, -1))
    ends = rows.filter(F.col("_b") == F.col("_c")).withColumn("_part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("_left") - F.coalesce(run, F.lit(0)))))
    rest = rows.filter(F.col("_b") != F.col("_c")).withColumn("_part", F.when(F.col("_b") < F.col("_c"), F.col("size")).otherwise(0))
    out = rest.unionByName(ends).withColumn("taken", F.col("_epochs") * F.col("size") + F.col("_part"))
    return out.drop("_left", "_c", "_v", "_b")


def mix_sources(docs: DataFrame, seed: int = 17, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0, quality: Column | None = None) -> DataFrame:
    """docs with doc_id, text, source: adds size, source_size, target and taken (words taken, repeats counted)."""
    return take(ranked(docs.drop(*OUT), seed, quality), weights, most).drop("_epochs", "_part")


def mixed_rows(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: each row as often as it is taken, a part as its first words with their spacing; the columns of docs, whatever their names."""
    others = [c for c in docs.columns if c not in ("doc_id", "text", "source")]
    how = {"seed": 17, "quality": None, "weights": (1, 2, 3), "most": 3.0} | how
    # What the mix adds has names that a caller's columns may have too: those are kept apart.
    narrow = docs.select("doc_id", "text", "source", F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in others]).alias("_row"))
    keep = [F.col(f"_row.`{c}`").alias(c) if c in others else F.col(c) for c in docs.columns]
    taken = take(ranked(narrow, how["seed"], how["quality"]), how["weights"], how["most"])
    whole = F.col("_epochs") + F.when(F.col("_part") == F.col("size"), F.lit(1)).otherwise(0)
    full = taken.filter("size > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.greatest(whole, F.lit(1))))).filter(whole > 0).select(*keep)
    some = taken.filter("_part > 0 and _part < size")
    first = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(f"(?:{SPACE})?{WORD}"), F.lit(0)), 1, F.col("_part").cast("int")), "")
    return full.union(some.withColumn("text", first).select(*keep))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    rows = cut(ranked(docs).drop("text"))  # narrow: the texts are read once
    return take(rows).select("doc_id", "size", "source_size", "target", "taken")

"""Which short texts stand in which others: joins on parts of a text, without pairing all with all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.functions.text import col
from sextant.plans.storage import cut

GRAM = 3
RUN = r"(?U)(\w+)"
#: Two neighbouring words with what is between them; each word begins one.
PAIR = r"(?U)\b(?=(\w++\W++\w++))"


def held(texts: DataFrame, parts: DataFrame) -> DataFrame:
    """(text, part): each distinct text with the parts, of GRAM characters or more, that stand in it anywhere.

    Where a text has the first GRAM characters of a part, what it has there of each length that such parts have is looked up among the parts: joins
    on equality, whose rows grow with the texts, however many parts have a run in common. Meant for texts of a line, such as modules.
    """
    texts = texts.select("text").distinct().filter(F.length("text") >= GRAM)
    parts = parts.select("part").distinct().filter(F.length("part") >= GRAM)
    heads = parts.groupBy(F.substring("part", 1, GRAM).alias("head")).agg(F.collect_set(F.length("part")).alias("sizes"))
    places = texts.select("text", F.explode(F.sequence(F.lit(1), F.length("text") - GRAM + 1)).alias("at"))
    begun = places.withColumn("head", F.substring("text", F.col("at"), F.lit(GRAM))).join(heads, "head")
    tried = begun.select("text", "at", F.explode("sizes").alias("size")).filter(F.col("at") + F.col("size") - 1 <= F.length("text"))
    return tried.select("text", F.substring("text", F.col("at"), F.col("size")).alias("part")).join(parts, "part").select("text", "part").distinct()


def quoted(text: Column | str) -> Column:
    """A pattern for a text as it is."""
    return F.regexp_replace(col(text), r"([^\p{L}\p{N}_\s])", r"\\$1")


def word_pattern(text: Column | str) -> Column:
    return F.concat(F.lit(r"(?U)\b"), quoted(text), F.lit(r"\b"))


def key_run(name: Column | str) -> Column:
    """The longest run of word characters of a name: where the name stands between word borders, it stands there as a whole word."""
    return F.array_max(F.transform(F.regexp_extract_all(col(name), F.lit(RUN), F.lit(1)), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]


def runs(text: Column | str) -> Column:
    return F.regexp_extract_all(col(text), F.lit(RUN), F.lit(1))


def pairs(text: Column | str) -> Column:
    return F.regexp_extract_all(col(text), F.lit(PAIR), F.lit(1))


def words(df: DataFrame, *keep: str, column: str = "content") -> DataFrame:
    """(*keep, word): the distinct words of each row's text."""
    return df.select(*keep, F.explode(F.array_distinct(F.regexp_extract_all(column, F.lit(RUN), F.lit(1)))).alias("word"))


def standing(names: DataFrame, texts: DataFrame) -> DataFrame:
    """(name): the names that stand between word borders in one of the texts (content), as they are written.

    A name of one word, or of two with what is between them, is looked up among the distinct words and neighbouring pairs of all texts. Another is
    looked up by the rarest of its pairs (of its words, if it has one) in the texts that have it, and verified there: a text is fetched once, by its hash.
    """
    names, texts = cut(names.select("name").distinct()), texts.select("content")
    whole = F.col("name").rlike(r"(?U)^\w+(?:\W+\w+)?$")
    said = texts.select(F.explode(F.array_distinct(F.concat(runs("content"), pairs("content")))).alias("name"))
    simple = names.filter(whole).join(said, "name", "left_semi")
    if names.filter(~whole).isEmpty():
        return simple
    others = names.filter(~whole).select("name", F.when(F.size(pairs("name")) > 0, pairs("name")).otherwise(runs("name")).alias("pieces"))
    others = others.select("name", F.explode(F.array_distinct("pieces")).alias("piece"))
    # Only what such names have is counted and looked up.
    by_text = texts.select(F.xxhash64("content").alias("t"), F.array_distinct(F.concat(runs("content"), pairs("content"))).alias("pieces"))
    by_text = by_text.select("t", F.explode("pieces").alias("piece")).join(others.select("piece").distinct(), "piece", "left_semi")
    n = by_text.groupBy("piece").agg(F.count("*").alias("n"))
    rarest = others.join(n, "piece", "left").groupBy("name").agg(F.count_if(F.col("n").isNull()).alias("lost"), F.min_by("piece", F.struct("n", "piece")).alias("piece")).filter("lost = 0").drop("lost")
    tried = by_text.join(rarest, "piece").select("t", "name").distinct()
    met = texts.select(F.xxhash64("content").alias("t"), "content").join(tried.groupBy("t").agg(F.collect_list("name").alias("names")), "t")
    found = met.select("content", F.explode("names").alias("name")).filter(F.regexp_like("content", word_pattern("name"))).select("name")
    return simple.union(found).distinct()

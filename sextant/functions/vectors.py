"""Vectors as arrays of floats; sums are made in double."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.functions.text import col


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column | str, b: Column | str) -> Column:
    """Null for vectors of unequal or no length, or of norm 0."""
    value = F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
    return F.when((F.size(col(a)) == F.size(col(b))) & (F.size(col(a)) > 0), value)


def fitted(v: Column | str, dim: int) -> Column:
    """Cut or filled with zeros to a length; null stays null."""
    x = col(v)
    return F.when(F.size(x) >= dim, F.slice(x, 1, dim)).otherwise(F.concat(x, F.array_repeat(F.lit(0.0).cast("float"), F.lit(dim) - F.size(x))))


def scored(df: DataFrame, vector: str, query: list[float], out: str = "score") -> DataFrame:
    """Adds the cosine with one query vector, which travels as a literal."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return df.withColumn(out, cosine(vector, q))


def top(df: DataFrame, k: int, by: str = "score", order: str = "ord") -> DataFrame:
    """The k best rows, ties in the order of the table (a bounded heap in each task)."""
    return df.orderBy(F.desc_nulls_last(by), F.asc(order)).limit(k)

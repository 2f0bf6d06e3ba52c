"""Connected components by alternating stars, on tables: no component or link set is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.llm.common import cut

#: Edges of a task, about: small edge tables don't take the session's number of partitions.
EDGES = 200_000


def _held(df: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges behind a checkpoint, in as many partitions as they need; their number and checksum."""
    e = cut(df)
    r = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return e.coalesce(max(1, r[0] // EDGES)), (r[0], r[1])


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of longs -> (node, root): root is the least node of the component; nodes without edges are left out.

    Each round hangs the larger neighbours of a node to its least neighbour, then the smaller ones; the rounds needed grow with
    the logarithm of the number of nodes. Every round ends in a checkpoint.

    Defined cases: null ends, loops and repeated edges are ignored; an empty table gives no rows; further columns are ignored.
    """
    e, before = _held(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    while True:
        both = e.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v"))))).select("col.u", "col.v")
        # Larger neighbours: the least neighbour is aggregated before the shuffle, since a node may have very many.
        least = both.groupBy(F.col("u").alias("w")).agg(F.least(F.min("v"), F.col("w")).alias("m"))
        large = both.filter("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = large.union(least.filter("w <> m").select("w", "m"))
        # Smaller neighbours: every edge now leads to a smaller node. Aggregated, then joined: a node's edges can be split.
        large = cut(large.distinct())
        small = large.join(large.groupBy(F.col("a").alias("w")).agg(F.min("b").alias("m")), F.col("a") == F.col("w"))
        small = small.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b"))))).select("col.a", "col.b")
        e, after = _held(small.filter("a <> b").distinct())
        if after == before:
            break
        before = after
    return e.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("root")), F.struct(F.col("b").alias("node"), F.col("b").alias("root"))))).select("col.*").distinct()

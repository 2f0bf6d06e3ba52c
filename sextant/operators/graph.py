"""Paths and walks over edge tables, level by level. Levels are tables in the checkpoint folder: no row of them passes through the driver, plans
stay short, and a lost executor costs one level."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sextant.plans.storage import cut


#: A table of so many rows at most is sent to all tasks.
FEW = 20_000


def small(df: DataFrame) -> DataFrame:
    """The table, to be broadcast if its rows are counted to be few."""
    df = cut(df)
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


def shortest_path(edges: DataFrame, start: str, goal: str) -> DataFrame:
    """shortest_way over a table of edges (src, dst), which go both ways."""
    if start == goal:
        return shortest_way(edges.sparkSession, lambda files: files, start, goal)
    both = cut(edges.select("src", "dst").union(edges.select(F.col("dst"), F.col("src"))).distinct())
    return shortest_way(edges.sparkSession, lambda files: files.join(both, "src"), start, goal)


def shortest_way(spark: SparkSession, hop: Callable[[DataFrame], DataFrame], start: str, goal: str) -> DataFrame:
    """(step, node): a shortest path in an undirected graph, the least parent first; no row where there is none. hop gives the edges (src, dst) of nodes (src).

    Breadth first, until the goal is found or no node is new: each level is a hop from the frontier; visited nodes are
    taken out by an anti-join. As edges go both ways, those are in the frontier or the level before it.
    """
    first = spark.createDataFrame([(start, None)], "node string, parent string")
    if start == goal:
        return first.select(F.lit(1).alias("step"), "node")
    levels = [first]
    while True:
        nxt = hop(levels[-1].select(F.col("node").alias("src"))).groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("parent"))
        for seen in levels[-2:]:
            nxt = nxt.join(seen.select("node"), "node", "left_anti")
        nxt = cut(nxt)
        if nxt.isEmpty():
            return first.limit(0).select(F.lit(1).alias("step"), "node")
        levels.append(nxt)
        if not nxt.filter(F.col("node") == goal).isEmpty():
            break
    # Back from the goal: one row a level.
    at = levels[-1].filter(F.col("node") == goal)
    path = at.select(F.lit(len(levels)).alias("step"), "node")
    for k in range(len(levels) - 1, 0, -1):
        at = cut(levels[k - 1].join(at.select(F.col("parent").alias("node")), "node", "left_semi"))
        path = path.union(at.select(F.lit(k).alias("step"), "node"))
    return path


def reached(start: DataFrame, depth: int, hop: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    """The edges of all names within `depth` hops. start (src); hop gives a frontier's edges, a row each, with src and, where the walk may go on, next."""
    frontier, known, out = start, start, None
    for k in range(1, depth + 1):
        found = cut(hop(frontier, k))
        out = found if out is None else out.unionByName(found)
        frontier = found.select(F.col("next").alias("src")).filter("src is not null").distinct().join(known, "src", "left_anti")
        if k < depth:
            frontier = cut(frontier)
            known = known.union(frontier)
    return out


def first_of(edges: DataFrame, fan: int) -> DataFrame:
    """The first `fan` edges of each src, by ord, then dst."""
    return edges.withColumn("_k", F.row_number().over(Window.partitionBy("src").orderBy("ord", "dst"))).filter(F.col("_k") <= fan).drop("_k")


ENTRIES = "at int, hop int, src string, dst string, trail string, met array<string>"


def depth_first(edges: DataFrame, start: DataFrame, depth: int, most: int, unseen: bool) -> DataFrame:
    """Walks in order, depth first, entering a name once and none beyond `depth` hops or `most` rows: (at, hop, src, dst, trail, met).

    edges (src, ord, dst, next, said): said is what an edge adds to the trail. A row for each edge met, and one without dst for each name
    that is entered, with the names entered before it and itself (met). unseen: edges to names that were entered before are left out.
    One task; what it gets is bounded by the caller: the names within `depth` hops and the first edges of each.
    """
    import pandas as pd

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        begin = rows[rows["ord"].isna()].iloc[0]
        rows = rows[rows["ord"].notna()].sort_values(["src", "ord", "dst"])
        out_of = {k: list(zip(g["dst"], g["next"], g["said"], strict=True)) for k, g in rows.groupby("src", sort=False)}
        found: list[tuple] = []
        met: list[str] = []
        n = 0

        def enter(name: str, hop: int, trail: str) -> None:
            nonlocal n
            if hop > depth or name in met or n >= most:
                return
            met.append(name)
            found.append((len(found), hop, name, None, trail, list(met)))
            ways = [w for w in out_of.get(name, ()) if not (unseen and w[0] in met)]
            for dst, nxt, said in ways:
                if not unseen and n >= most:
                    return
                n += 1
                found.append((len(found), hop, name, dst, f"{trail} → {said}", None))
                if nxt is not None:
                    enter(nxt, hop + 1, f"{trail} → {said}")

        enter(begin["src"], 1, begin["said"])
        return pd.DataFrame(found, columns=["at", "hop", "src", "dst", "trail", "met"])

    both = edges.select("src", F.col("ord").cast("long").alias("ord"), "dst", "next", "said").unionByName(start.select("src", "said"), allowMissingColumns=True)
    return both.groupBy().applyInPandas(lambda rows: run(rows.astype(object).where(rows.notna(), None)), ENTRIES)

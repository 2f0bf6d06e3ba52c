"""The nearest vector of each of many: matrix products of blocks, a best one a block, and a merge."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Asked vectors of a block, vectors of a shard, and asked vectors that are multiplied at a time.
ASKED, SHARD, STEP = 16_384, 16_384, 1024
#: Scores are compared to so many places, so that equal vectors are equally near wherever they lie.
PLACES = 12


def _unit(column: pd.Series) -> np.ndarray:
    m = np.array([np.asarray(v, dtype=np.float64) for v in column])
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def _best(asked: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
    """Of one block and one shard: for each asked vector the nearest, the one with the least ord of equally near ones."""
    out = []
    for size, a in asked.groupby(asked["asked"].map(len)):
        v = vectors[vectors["emb"].map(len) == size].sort_values("ord")
        if len(v) == 0:
            continue
        m = _unit(v["emb"])
        keep = m.any(axis=1)
        v, m = v[keep], m[keep]
        q = _unit(a["asked"])
        for i in range(0, len(a) if len(v) else 0, STEP):
            sim = np.round(q[i : i + STEP] @ m.T, PLACES)
            best = sim.argmax(axis=1)
            some = q[i : i + STEP].any(axis=1)
            out.append(pd.DataFrame({"id": a["id"].to_numpy()[i : i + STEP][some], "ord": v["ord"].to_numpy()[best][some], "score": sim.max(axis=1)[some]}))
    return pd.concat(out) if out else pd.DataFrame({"id": [], "ord": [], "score": []})


def nearest(asked: DataFrame, vectors: DataFrame) -> DataFrame:
    """(id, ord, score): of asked (id, asked) the nearest of vectors (ord, emb) by cosine; none for zeros, nulls and lengths that nothing has.

    The vectors are dealt over shards, and sent once for every ASKED asked ones; these go to every shard. A task holds a block and a shard and
    a product of STEP by SHARD numbers; of its result, one row for each asked vector is left.
    """
    asked = asked.filter(F.size("asked") > 0)
    n = asked.count()
    rows = vectors.filter(F.size("emb") > 0).select("ord", "emb")
    blocks, shards = max(1, -(-n // ASKED)), max(1, -(-rows.count() // SHARD))
    left = asked.select("id", "asked", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    right = rows.select("ord", "emb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("of_block"), F.pmod(F.xxhash64("ord"), F.lit(shards)).cast("int").alias("of_shard"))
    found = left.groupBy("block", "shard").cogroup(right.groupBy("of_block", "of_shard")).applyInPandas(lambda a, v: _best(a, v), "id long, ord long, score double")
    return found.groupBy("id").agg(F.max_by(F.struct("ord", "score"), F.struct("score", -F.col("ord"))).alias("b")).select("id", "b.ord", "b.score")

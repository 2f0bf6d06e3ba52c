"""Clusters of a folder's documents against the plain greedy loop, with small blocks and shards."""

import random

import numpy as np
import pytest

from sextant.operators import docs

SCHEMA = "directory string, file_path string, emb array<float>, ord long"


def plain(rows, threshold):
    out = {}
    for d in {r[0] for r in rows}:
        centres = []
        for _, path, emb, _ in sorted((r for r in rows if r[0] == d and r[2]), key=lambda r: (r[3], r[1])):
            v = np.asarray(emb, np.float32).astype(float)
            best, at = 0.0, -1
            for k, c in enumerate(centres):
                n = np.linalg.norm(v) * np.linalg.norm(c)
                if n and v @ c / n > best:
                    best, at = v @ c / n, k
            if at < 0 or best < threshold:
                centres.append(v)
                at = len(centres) - 1
            out[d, path] = at
    return out


@pytest.mark.parametrize(("leaders", "shard"), [(1024, 4096), (3, 5)])
def test_cluster_is_the_plain_one(spark, monkeypatch, leaders, shard):
    monkeypatch.setattr(docs, "LEADERS", leaders)
    monkeypatch.setattr(docs, "SHARD", shard)
    dice = random.Random(5)
    rows = [(d, f"{d}/f{i}.md", [dice.gauss(0, 1) for _ in range(3)], i // 2) for d, n in (("a", 40), ("b", 9)) for i in range(n)]
    rows += [("a", "a/zero.md", [0.0, 0.0, 0.0], 4), ("b", "b/none.md", None, 1), ("b", "b/empty.md", [], 1)]
    got = docs.cluster(spark.createDataFrame(rows, SCHEMA), 0.7).collect()
    assert {(r.directory, r.file_path): r.cluster for r in got} == plain(rows, 0.7) and {r.suggestion for r in got} == {None}


def test_the_nearest_centre_counts_and_few_files_are_not_split(spark):
    turn = lambda x: [float(np.cos(np.radians(x))), float(np.sin(np.radians(x)))]
    rows = [("a", "1", turn(0), 1), ("a", "2", turn(50), 2), ("a", "3", turn(41), 3), ("a", "4", turn(120), 4), ("b", "x", turn(0), 1), ("b", "y", turn(0), 2), ("c", "p", turn(0), 1), *[("c", f"q{i}", None, i) for i in range(4)]]
    got = docs.cluster(spark.createDataFrame(rows, SCHEMA), 0.75).collect()
    assert {(r.directory, r.file_path): r.cluster for r in got if r.suggestion is None} == {("a", "1"): 0, ("a", "2"): 1, ("a", "3"): 1, ("a", "4"): 2}  # 3 is at 0.75 of the first as well
    assert {r.directory: r.suggestion for r in got if r.suggestion} == {"b": "Folder has fewer than 4 docs — no split needed.", "c": "Not enough embedded docs to cluster."}
    assert docs.cluster(spark.createDataFrame([], SCHEMA)).collect() == []


def test_products_are_bounded_and_rounds_few(spark, monkeypatch):
    """A task multiplies STEP rows at a time with a block's centres, which may therefore be many; folders that are all apart take few rounds."""
    import pandas as pd

    assert docs.LEADERS >= 8192 and docs.STEP * docs.LEADERS * 8 <= 32 << 20
    monkeypatch.setattr(docs, "STEP", 2)
    dice = np.random.default_rng(3)
    rows = pd.DataFrame({"directory": "a", "file_path": [f"f{i}" for i in range(40)], "ord": np.arange(40) // 3, "emb": list(dice.normal(size=(40, 3)))})
    rows = rows.sort_values(["ord", "file_path"], ignore_index=True)
    centres = docs._settled(0.7)(rows).assign(cluster=lambda x: range(len(x)))
    got = docs._nearest(rows.sample(frac=1, random_state=1), centres).set_index("file_path")["cluster"].to_dict()
    assert got == {p: k for (_, p), k in plain([("a", r.file_path, r.emb.tolist(), r.ord) for r in rows.itertuples()], 0.7).items()}
    assert len(docs._uncovered(0.7)(rows, centres)) == 0

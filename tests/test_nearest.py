"""The nearest of many vectors against a plain loop, with small blocks and shards."""

import random

import numpy as np
import pytest

from sextant.operators import nearest


def near(q, rows):
    best = None
    for o, v in sorted(rows, key=lambda r: r[0]):
        if v is None or len(v) != len(q) or not any(v) or not any(q):
            continue
        s = round(float(np.dot(q, v) / np.linalg.norm(q) / np.linalg.norm(v)), 9)
        if best is None or s > best[1]:
            best = (o, s)
    return best


@pytest.mark.parametrize("size", [16_384, 7])
def test_nearest_is_the_plain_one(spark, monkeypatch, size):
    for name in ("ASKED", "SHARD"):
        monkeypatch.setattr(nearest, name, size)
    monkeypatch.setattr(nearest, "STEP", 5)
    dice = random.Random(2)
    vector = lambda: [float(dice.randint(-2, 2)) for _ in range(4)]
    rows = [(i, vector()) for i in range(60)] + [(100, None), (101, []), (102, [1.0, 2.0]), (103, [0.0] * 4)]
    asked = [(i, vector()) for i in range(40)] + [(50, [2.0, 4.0]), (51, [1.0]), (52, None), (53, [0.0] * 4), (54, [])]
    got = nearest.nearest(spark.createDataFrame(asked, "id long, asked array<double>"), spark.createDataFrame(rows, "ord long, emb array<double>")).collect()
    want = {i: near(q, rows) for i, q in asked if q}
    assert {r.id: (r.ord, round(r.score, 9)) for r in got} == {i: b for i, b in want.items() if b}
    none = nearest.nearest(spark.createDataFrame([], "id long, asked array<double>"), spark.createDataFrame(rows, "ord long, emb array<double>"))
    assert none.collect() == []

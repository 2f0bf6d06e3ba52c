import random

import pytest

from sextant.llm.graph import components
from sextant.llm.jaccard import Union


@pytest.mark.parametrize("seed", [1, 2])
def test_components_match_union_find(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, i) for i in range(4000, 4200)]
    u = Union(6000)
    for a, b in edges:
        u.join(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: min(y for y in nodes if u.find(y) == u.find(x)) for x in nodes}


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []

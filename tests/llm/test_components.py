import random

import pytest

from thalweg.llm.components import connected_components


@pytest.mark.parametrize("most", [2, 15, 10**6])
def test_against_union_find(spark, most):
    r = random.Random(most)
    edges = [(i, i + 1) for i in range(40)] + [(100 + r.randrange(40), 100 + r.randrange(40)) for _ in range(25)] + [(-5, 900), (900, 901), (7, 7), (None, 3), (3, None)]
    edges += edges[:5]
    up = {}

    def top(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            x, y = top(a), top(b)
            up[max(x, y)] = min(x, y)
    nodes = {x for a, b in edges if None not in (a, b) and a != b for x in (a, b)}
    got = connected_components(spark.createDataFrame(edges, "u long, v long"), most=most).collect()
    assert {r.node: r.root for r in got} == {x: top(x) for x in nodes if top(x) != x} and len(got) == len({r.node for r in got})


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0

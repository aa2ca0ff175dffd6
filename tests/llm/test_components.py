"""Components of links, in one part and in many, against union-find."""

import random

import pytest

from basalt.llm.components import components


@pytest.mark.parametrize("part", [250_000, 150])
def test_components_equal_union_find(spark, part):
    """Chains, a hub, random graphs, repeats, loops and nulls; parts smaller than the links need stars between them."""
    rng = random.Random(part)
    links = [(i, i + 1) for i in range(1000, 1120)] + [(5000, i) for i in range(5001, 5200)] + [(9000 - i, 9001 - i) for i in range(0, 120, 2)]
    links += [(rng.randint(-300, 300), rng.randint(-300, 300)) for _ in range(260)]
    rng.shuffle(links)
    rows = [*links, *links[:50], (7, 7), (77777, 77777), (None, 3), (4, None), (None, None)]
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in links:
        if a != b:
            a, b = sorted((find(a), find(b)))
            top[b] = a
    got = [(r.node, r.component) for r in components(spark.createDataFrame(rows, "a long, b long").repartition(5), part=part).collect()]
    assert sorted(got) == sorted((x, find(x)) for x in top)


def test_no_links(spark):
    assert components(spark.createDataFrame([(1, 1), (None, 2)], "a long, b long")).collect() == []

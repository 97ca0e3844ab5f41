"""What is told of groups without making their pairs is what the pairs tell; no plan holds more pairs than members."""

import random

import pytest
from lodestrata.operators import centrality
from lodestrata.operators import graph as g


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    r = [(i, x) for i in range(70) for x in rng.choices(range(45), k=rng.choice((1, 2, 2, 3, 4, 5)))]
    r += [(100 + i, x) for i in range(12) for x in (60 + i, 61 + i + i // 5)] + [(200, None), (200, 5), (None, 1), (None, 2), (300, 90), (301, 91), (301, 92), (302, 91), (302, 92)]
    return spark.createDataFrame(r, "g long, x long").cache()


@pytest.fixture(scope="module")
def edges(rows):
    return g.cooccurrence(rows, "g", "x", 1).cache()


def both(a, b):
    return [sorted(map(tuple, df.collect())) for df in (a, b)]


def test_components_of_groups(rows, edges):
    got, want = both(g.components(g.stars(rows, "g", "x")), g.components(edges))
    assert got == want and len({c for _, c in got}) > 2


def test_bridges_of_groups(rows, edges):
    got, want = both(centrality.bridges_of_groups(rows, "g", "x"), centrality.bridges(edges))
    assert got == want and (91, 92) in got and (90, 91) not in got and len(got) > 3


def test_a_large_group_costs_its_members(spark):
    rows = spark.range(20_000).selectExpr("id % 2 as g", "id as x")  # 100 million pairs
    assert g.components(g.stars(rows, "g", "x")).select("component").distinct().count() == 2


@pytest.mark.parametrize("block", [2, 1_000])
def test_merged_members_are_paired_once(spark, rows, edges, block):
    stones = spark.createDataFrame([(x, x - x % 5) for x in range(93) if x % 5 in (1, 4)] + [(60, 92)], "node long, survivor long")
    merged = g.cooccurrence(rows, "g", "x", 1, block, survivors=stones)
    got, want = both(merged, g.redirect(edges, stones))
    assert got == want and max(w for *_, w in got) > 2
    assert merged._jdf.queryExecution().analyzed().toString().count("sum(") == 1  # edges are folded once

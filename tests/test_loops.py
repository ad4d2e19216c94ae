"""Loops over tables that are made anew from themselves: what the driver keeps of them stays small."""

from __future__ import annotations

import random

from plumbline.functions.graph import connected_components
from plumbline.functions.greedy import keep_best
from plumbline.functions.outlines import trace_rings


def estimate(df) -> int:
    """Bits of the size that the optimizer estimates."""
    return df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length()


def test_components_of_long_chains(spark):
    nodes = list(range(1, 301))
    random.Random(3).shuffle(nodes)
    chain = [(a, b) for a, b in zip(nodes, nodes[1:])] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 5000), (6000, 6001), (6001, 6000), (6000, 6001)]
    found = connected_components(spark.createDataFrame(chain, "src long, dst long"))
    assert estimate(found) < 40
    assert dict(map(tuple, found.collect())) == {n: 1 for n in nodes} | {1000 + i: 1000 for i in range(41)} | {5000: 5000, 6000: 6000, 6001: 6000}


def test_components_of_random_graphs(spark):
    rng = random.Random(8)
    edges = [(f"n{rng.randrange(400):03}", f"n{rng.randrange(400):03}") for _ in range(220)]
    want = {n: n for e in edges for n in e}
    for _ in want:
        for a, b in edges:
            want[a] = want[b] = min(want[a], want[b])
    assert dict(map(tuple, connected_components(spark.createDataFrame(edges, "src string, dst string")).collect())) == want
    assert connected_components(spark.createDataFrame([], "src string, dst string")).count() == 0


def test_rounds_of_a_pass_and_of_rings(spark):
    line = spark.range(24).selectExpr("id node", "id rank")
    kept = keep_best(line, spark.range(23).selectExpr("id src", "id + 1 dst"))
    assert estimate(kept) < 40
    assert sorted(r.node for r in kept.collect()) == list(range(0, 24, 2))
    rings = trace_rings(spark.range(200).selectExpr("'k' key", "id a", "(id + 1) % 200 b"), "key")
    assert estimate(rings) < 200
    assert sorted((r.a, r.place, r.ring) for r in rings.collect()) == [(i, i, 0) for i in range(200)]

"""Contraction of a graph by clusters against counting in plain Python."""

import random
from collections import Counter

import pytest

from lodespark.operators import graph as G


@pytest.mark.parametrize("seed", [1, 2])
def test_contraction_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    clusters = [(f"n{k}", f"k{rnd.randrange(6)}") for k in range(40)] + [("n1", "k0"), (None, "k1"), ("n45", None)]
    edges = [(f"n{rnd.randrange(46)}", f"n{rnd.randrange(46)}", rnd.choice(["supports", "contradicts", None]), "x") for _ in range(500)] + [(None, "n1", "supports", "x")]
    of = {}
    for n, c in clusters:
        if n and c:
            of[n] = max(of.get(n, ""), c)
    counts = Counter((of[a], of[b], r) for a, b, r, _ in edges if a in of and b in of and r and of[a] != of[b])
    want = {}
    for (a, b, r), n in sorted(counts.items(), key=lambda x: (-x[1], x[0])):
        want.setdefault((min(a, b), max(a, b)), (a, b, r, n, min(5, 1 + n // 3)))
    e, c = spark.createDataFrame(edges, "a string, b string, relation string, n string"), spark.createDataFrame(clusters, "node string, cluster string")
    got = G.contracted(e, c).collect()
    assert sorted(tuple(x) for x in got) == sorted(want.values())
    assert G.contracted(e.where("false"), c).count() == 0 and G.contracted(e, c.where("false")).count() == 0


def test_query(same):
    from lodespark.plans.literature import QUERIES

    same(*QUERIES["contracted_edges"])

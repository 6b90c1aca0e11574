"""Dominators against their definition: ids that can't be reached without another."""

import random

import pytest

from tests.test_fixpoint import brute
from tracelens.plans.dominators import dominators


def by_definition(edges, root):
    reached = brute(edges, [root])
    doms = {v: {d for d in reached if d != v and v not in brute([e for e in edges if d not in e], [root] if d != root else [])} for v in reached - {root}}
    # the nearest is the one that all the others dominate
    return {v: max(ds, key=lambda d: len(doms.get(d, ()))) for v, ds in doms.items()}


@pytest.mark.parametrize("seed", [1])
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    n = 40
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(int(1.7 * n))] + [(0, rng.randrange(n)) for _ in range(2)] + [(3, 3), (50, 51), (5, 0)]
    edges += [(i, i + 1) for i in range(20, 30)]
    got = {r["id"]: r["dominator"] for r in dominators(spark.createDataFrame([*edges, (None, 3), (4, None)], "src long, dst long"), 0).collect()}
    assert got == by_definition(edges, 0) and len(got) > 15


def test_no_edges(spark):
    assert dominators(spark.createDataFrame([], "src long, dst long"), 0).count() == 0

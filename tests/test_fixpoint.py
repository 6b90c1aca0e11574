import random

import pytest

from tracelens.plans import fixpoint
from tracelens.plans.components import components


def brute(edges, seeds):
    after = {}
    for a, b in edges:
        after.setdefault(a, []).append(b)
    seen, stack = set(seeds), list(seeds)
    while stack:
        for b in after.get(stack.pop(), ()):
            if b not in seen:
                seen.add(b)
                stack.append(b)
    return seen


def reached(spark, edges, seeds):
    out = fixpoint.reach(spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame([(s,) for s in seeds], "id long"))
    rows = [r["id"] for r in out.collect()]
    assert len(rows) == len(set(rows))
    return set(rows), len(out.inputFiles())


def shuffled_list(n, back, rng):
    """A list whose ids have no order, with an item at every node; ``back`` links it both ways."""
    ids = list(range(n))
    rng.shuffle(ids)
    edges = list(zip(ids, ids[1:])) + [(i, 10 * n + i) for i in ids]
    return ids[0], edges + [(b, a) for a, b in zip(ids, ids[1:])] * back


@pytest.mark.parametrize("back", [False, True])
def test_long_lists_take_few_rounds(spark, back, monkeypatch):
    rounds = []
    plain, star = fixpoint.counted, fixpoint.components
    monkeypatch.setattr(fixpoint, "counted", lambda df, path: rounds.append(path) or plain(df, path))

    def stars(edges, base):
        out = star(edges, base)
        last = out.inputFiles()[0]
        rounds.extend(range(int(last.partition("stars=")[2].partition("/")[0]) + 1))
        return out

    monkeypatch.setattr(fixpoint, "components", stars)
    start, edges = shuffled_list(20_000, back, random.Random(1))
    assert reached(spark, edges, [start])[0] == brute(edges, [start])
    print(len(rounds), "rounds")
    assert len(rounds) < 100


def test_random_graphs_with_loops_and_cycles(spark, monkeypatch):
    monkeypatch.setattr(fixpoint, "PRUNE", 2)
    monkeypatch.setattr(fixpoint, "PATIENCE", 1)
    rng = random.Random(7)
    for n, m in ((40, 45), (60, 66)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(i, i + 1) for i in range(n, n + 12)] + [(n - 1, n)]
        seeds = [rng.randrange(n), n + 3]
        assert reached(spark, edges, seeds)[0] == brute(edges, seeds)


def test_mutual_references_become_one(spark, monkeypatch):
    """Random graphs with pairs both ways, chains of them and edges out of merged ids, contracted at the first chance."""
    monkeypatch.setattr(fixpoint, "PRUNE", 2)
    monkeypatch.setattr(fixpoint, "PATIENCE", 1)
    rng = random.Random(11)
    for n in (30, 80):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(n)]
        edges += [(b, a) for a, b in edges[: n // 2]] + [e for i in range(n, n + 9) for e in ((i, i + 1), (i + 1, i))] + [(n + 9, 0)]
        seeds = [n + 4, rng.randrange(n)]
        assert reached(spark, edges, seeds)[0] == brute(edges, seeds)


def test_components(spark, tmp_path):
    rng = random.Random(5)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(7, 7)]
    found = {r["id"]: r["root"] for r in components(spark.createDataFrame(edges, "src long, dst long"), str(tmp_path / "c")).collect()}
    both = edges + [(b, a) for a, b in edges]
    assert found == {i: root for i in range(200) if (root := min(brute(both, [i]))) != i}


def test_nothing_to_follow(spark):
    assert reached(spark, [], [1, 2])[0] == {1, 2}
    assert reached(spark, [(1, 2)], [])[0] == set()
    assert reached(spark, [(1, None), (None, 3)], [1])[0] == {1}

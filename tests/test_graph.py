"""Cycles and impact paths against plain searches on random graphs."""

import random
from collections import defaultdict

import pytest

from edulens.operators import graph

EDGES = "edge_id long, source long, target long"


def random_edges(seed, nodes=40, count=60):
    rng = random.Random(seed)
    return [(k, rng.randrange(nodes), rng.randrange(nodes)) for k in range(count)]


def reach(edges):
    ahead = defaultdict(set)
    for _, a, b in edges:
        ahead[a].add(b)
    out = {}
    for a in list(ahead):
        seen, todo = set(), list(ahead[a])
        while todo:
            n = todo.pop()
            if n not in seen:
                seen.add(n)
                todo += ahead[n]
        out[a] = seen
    return out


@pytest.mark.parametrize("seed,count", [(1, 45), (2, 60), (3, 90)])
def test_components_equal_mutual_reach(spark, seed, count):
    edges = random_edges(seed, count=count)
    r = reach(edges)
    want = {(a, min(b for b in r[a] if a in r.get(b, ()))) for a in r if a in r[a]}
    df = spark.createDataFrame([*edges, (900, 5, None), (901, None, 6), edges[0]], EDGES)
    assert {tuple(x) for x in graph.strong_components(df).collect()} == want
    got = {(x.edge_id, x.cyclic) for x in graph.cyclic_edges(df.where("edge_id < 900")).collect()}
    assert got == {(k, a in r.get(b, ()) or a == b) for k, a, b in edges}


def test_no_cycles_and_no_edges(spark):
    df = spark.createDataFrame([(1, 1, 2), (2, 2, 3)], EDGES)
    assert graph.strong_components(df).count() == 0
    assert graph.strong_components(df.limit(0)).count() == 0
    assert [x.cyclic for x in graph.cyclic_edges(df).collect()] == [False, False]


def plain_paths(changed, edges, max_depth, cap):
    ahead = defaultdict(list)
    for k, a, b in edges:
        if a != b:
            ahead[a].append((k, b))
    out = {}
    for request in {c[0] for c in changed}:
        best, rank = {}, {}
        level = [(root, (), root, rk) for q, root, rk in changed if q == request]
        for depth in range(1, max_depth + 1):
            level = [(root, (*path, k), b, rk) for root, path, n, rk in level for k, b in ahead[n]]
            for root, path, n, rk in level:
                rank[n] = max(rank.get(n, rk), rk)
                best[n] = min(best.get(n, (depth, root, path)), (depth, root, path))
        order = sorted(best, key=lambda n: (best[n][0], n))
        for i, n in enumerate(order):
            d, root, path = best[n]
            out[request, n] = (d, root, list(path), rank[n], d == max_depth and bool([1 for _, a, _ in edges if a == n]), i < cap)
    return out


@pytest.mark.parametrize("seed", [4, 5])
def test_impact_paths_equal_plain_search(spark, seed):
    edges = random_edges(seed, count=55)
    rng = random.Random(seed)
    changed = [(rng.randrange(3), rng.randrange(40), rng.randrange(4)) for _ in range(8)]
    paths = graph.impact_paths(spark.createDataFrame(changed, "request long, root long, rank int"), spark.createDataFrame(edges, EDGES), 4, 6)
    got = {(x.request, x.node): (x.distance, x.root, x.path, x["rank"], x.leads_on, x.kept) for x in paths.collect()}
    want = plain_paths(changed, edges, 4, 6)
    assert got == want
    r = reach(edges)
    for x in graph.impact_summary(paths, spark.createDataFrame(edges, EDGES)).collect():
        own = {n: v for (q, n), v in want.items() if q == x.request}
        cycles = sum(a in own and (a == b or a in r.get(b, ())) for _, a, b in edges)
        partial = cycles > 0 or any(v[4] or not v[5] for v in own.values())
        assert (x.objects, x.cycles, x.status) == (sum(v[5] for v in own.values()), cycles, "partial" if partial else "complete")
    assert graph.impact_paths(spark.createDataFrame([], "request long, root long, rank int"), spark.createDataFrame(edges, EDGES)).count() == 0

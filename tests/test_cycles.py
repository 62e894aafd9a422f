"""Chains longer than any fixed number of rounds, and cycles of every kind."""

import random

from edulens.operators import policy, quality


def nodes(df):
    return sorted(r.node for r in df.collect())


def brute(edges):
    cur = set(edges)
    while True:
        alive = {s for s, _ in cur}
        left = {e for e in cur if e[1] in alive}
        if left == cur:
            return sorted(alive)
        cur = left


def test_long_chain_is_no_cycle(spark):
    chain = [(i, i + 1) for i in range(40)]
    ring = [(100 + i, 100 + (i + 1) % 30) for i in range(30)] + [(200 + i, 201 + i) for i in range(20)] + [(220, 100)]
    got = nodes(policy.cyclic_nodes(spark.createDataFrame(chain + ring, "source long, target long")))
    assert got == list(range(100, 130)) + list(range(200, 221))


def test_cycles_equal_brute_force(spark):
    rng = random.Random(4)
    edges = [(a, b) for k in range(6) for a, b in ((1000 * k + rng.randrange(12), 1000 * k + rng.randrange(12)) for _ in range(5 + 2 * k))]
    edges += [(-i, -i - 1) for i in range(1, 5)] + [(-i, -i - 2) for i in range(1, 4)] + [(-3, -100), (-100, -101)]
    got = nodes(policy.cyclic_nodes(spark.createDataFrame(edges, "source long, target long")))
    assert got == brute(edges)


def test_alias_chain_beyond_256(spark):
    data = [(f"a{i:04d}", f"a{i + 1:04d}") for i in range(600)] + [("x", "y"), ("y", "x"), ("z", "x"), ("s", "s"), ("n", None)]
    got = {r.alias: (r.target, r.steps, r.cyclic) for r in quality.resolve_aliases(spark.createDataFrame(data, "alias string, target string")).collect()}
    assert all(got[f"a{i:04d}"] == ("a0600", 600 - i, False) for i in range(600))
    assert {k: got[k] for k in "xyzsn"} == {**{k: (None, None, True) for k in "xyzs"}, "n": (None, 1, False)}

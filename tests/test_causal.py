"""Causal graphs against path enumeration and planted structures."""

from __future__ import annotations

import random
from itertools import combinations

import pytest

from tallymark.operators import causal, graph

LINKS = "parent string, child string"


def blocked(links, x, y, z):
    """Whether every path between x and y is blocked: all simple paths, one by one."""
    into = {}
    for a, b in links:
        into.setdefault(a, set()).add(b)
    near = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)

    def below(n, seen=()):
        out = {n}
        for m in into.get(n, ()):
            out |= below(m)
        return out

    def walk(path):
        if path[-1] == y:
            for a, b, c in zip(path, path[1:], path[2:]):
                collider = b in into.get(a, ()) and b in into.get(c, ())
                if collider and not below(b) & set(z) or not collider and b in z:
                    return False
            return True
        return any(walk([*path, n]) for n in near.get(path[-1], ()) if n not in path)

    return not walk([x])


def test_separation_against_all_paths(spark):
    rng = random.Random(3)
    for _ in range(2):
        names = "abcdefg"
        links = [(a, b) for a, b in combinations(names, 2) if rng.random() < 0.35]
        asked = [(x, y, sorted(z)) for x in names for y in names if x != y for k in range(3) for z in combinations([n for n in names if n not in (x, y)], k)]
        got = causal.separated(spark.createDataFrame(links + links[:2] + [(None, "a")], LINKS), spark.createDataFrame(asked, "x string, y string, z array<string>"))
        found = {(r.x, r.y, tuple(r.z)): r.separated for r in got.collect()}
        assert len(found) == len(asked)
        for x, y, z in asked:
            assert found[x, y, tuple(z)] == blocked(links, x, y, z), (links, x, y, z)


def test_closure_of_cycles_and_long_chains(spark):
    chain = [(f"n{i}", f"n{i + 1}") for i in range(25)] + [("p", "q"), ("q", "p"), ("q", "r"), ("n0", "n2")]
    got = {(r.ancestor, r.node): r.depth for r in graph.descendants(spark.createDataFrame(chain, LINKS)).collect()}
    assert got["n0", "n25"] == 24 and got["n0", "n2"] == 1 and ("n25", "n0") not in got
    assert got["p", "p"] == 2 and got["q", "q"] == 2 and got["p", "r"] == 2
    assert graph.descendants(spark.createDataFrame([], LINKS)).count() == 0


@pytest.mark.parametrize("links,x,y,want", [
    ([("x", "y"), ("y", "z")], "x", "z", ([], "none")),
    ([("c", "x"), ("c", "y"), ("x", "y")], "x", "y", (["c"], "candidates")),
    ([("c", "x"), ("c", "y")], "x", "y", (["c"], "parents")),
    ([("u", "c"), ("c", "x"), ("u", "y")], "x", "y", (["c"], "parents")),
])
def test_adjustment_sets(spark, links, x, y, want):
    row = causal.adjustment_sets(spark.createDataFrame(links, LINKS), spark.createDataFrame([(x, y)], "x string, y string")).first()
    assert (row.z, row.taken) == want and row.blocks_backdoor


def learned(spark, rows, names):
    table = spark.createDataFrame([(1, *r) for r in rows], "g int, " + ", ".join(f"{n} double" for n in names))
    return {(r.source, r.target, r.directed) for r in causal.cpdag(table, "g", names).collect()}


def test_patterns_of_planted_structures(spark):
    rng = random.Random(6)
    gauss = lambda: rng.gauss(0, 1)
    collider, chain, meek = [], [], []
    for _ in range(1500):
        x, z = gauss(), gauss()
        collider.append((x, x + z + 0.5 * gauss(), z))
        y = x + 0.7 * gauss()
        chain.append((x, y, y + 0.7 * gauss()))
        m = x + z + 0.5 * gauss()
        meek.append((x, m, z, m + 0.7 * gauss()))
    assert learned(spark, collider, ["x", "y", "z"]) == {("x", "y", True), ("z", "y", True)}
    assert learned(spark, chain, ["x", "y", "z"]) == {("x", "y", False), ("y", "z", False)}
    assert learned(spark, meek, ["x", "m", "z", "w"]) == {("x", "m", True), ("z", "m", True), ("m", "w", True)}


def test_patterns_of_odd_groups(spark):
    names = ["x", "y", "z"]
    assert learned(spark, [(1.0, 2.0, 3.0)], names) == set()
    assert learned(spark, [(float(i), 5.0, None) for i in range(9)], names) == set()
    assert learned(spark, [], names) == set()


def test_pattern_scores(spark):
    schema = "g int, source string, target string, directed boolean"
    one = spark.createDataFrame([(1, "x", "y", True), (1, "z", "y", True), (2, "x", "z", False)], schema)
    two = spark.createDataFrame([(1, "y", "x", True), (1, "z", "y", True), (1, "x", "z", True)], schema)
    got = {r.g: (r.distance, r.n_hit, r.precision, r.recall) for r in causal.pattern_scores(one, two, "g", ["x", "y", "z"]).collect()}
    assert got == {1: (2, 2, 1.0, 0.666667), 2: (1, 0, 0.0, None)}


def test_patterns_of_many_groups_need_no_join(spark):
    """One aggregation finds the patterns of all groups, each as if it were alone."""
    rng = random.Random(8)
    names = ["x", "y", "z", "w"]
    rows = []
    for g in range(40):
        weights = [[rng.choice([0.0, 0.0, 0.3, 1.0]) for _ in names] for _ in names]
        for _ in range(80):
            v: list[float] = []
            for i in range(4):
                v.append(rng.gauss(0, 1) + sum(weights[i][j] * v[j] for j in range(i)))
            rows.append((g, *v))
    table = spark.createDataFrame(rows, "g int, " + ", ".join(f"{n} double" for n in names))
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("patterns", "patterns")
    found = causal.cpdag(table, "g", names)
    assert len(jobs.getJobIdsForGroup("patterns")) <= 3
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    told = {(r.g, r.source, r.target, r.directed) for r in found.collect()}
    for g in range(0, 40, 8):
        assert {t[1:] for t in told if t[0] == g} == learned(spark, [r[1:] for r in rows if r[0] == g], names)

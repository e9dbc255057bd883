"""Sobol points, Shapley values, principal directions and forests against plain Python and numpy."""

from __future__ import annotations

import math
import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymark.model import Spec
from tallymark.operators import explain, forest, prefer, sequence

SPECS = (Spec("p_x", 0.0, 10.0), Spec("p_y", -1.0, 1.0))
TRIALS = "campaign_id long, iteration long, p_x double, p_y double, kpi double, is_failure boolean"


def points(spark, n, d):
    rows = spark.range(n).select("id", *(sequence.coordinate(F.col("id"), i).alias(f"c{i}") for i in range(d))).orderBy("id").collect()
    return np.array([r[1:] for r in rows])


def test_sobol_is_the_gray_code_walk(spark):
    """Each point differs from the one before by one mask: that of the lowest zero digit of the number before."""
    got = points(spark, 600, sequence.DIMENSIONS)
    x = np.zeros(sequence.DIMENSIONS, dtype=np.int64)
    for i in range(600):
        if i:
            low = next(k for k in range(31) if not (i - 1) >> k & 1)
            x ^= np.array([sequence.masks(d)[low] for d in range(sequence.DIMENSIONS)])
        assert (got[i] == x / 2.0**30).all()


def test_sobol_is_a_net(spark):
    got = points(spark, 1024, sequence.DIMENSIONS)
    for lo in (0, 256, 768):
        assert all(len(set((got[lo : lo + 256, d] * 256).astype(int))) == 256 for d in range(sequence.DIMENSIONS))
    # No two coordinates are near to being one.
    assert all(len({(int(x * 16), int(y * 16)) for x, y in zip(got[:, a], got[:, b])}) > 60 for a, b in combinations(range(sequence.DIMENSIONS), 2))
    # Of the first two dimensions every box of area 1/256 holds one of 256 points.
    for k in range(9):
        assert len({(int(a * 2**k), int(b * 2 ** (8 - k))) for a, b in got[:256, :2]}) == 256


def test_sobol_goes_on_behind_a_campaign(spark):
    obs = spark.createDataFrame([(1, i, 1.0, 0.0, 1.0, False) for i in range(3)] + [(2, 0, 1.0, 0.0, None, True)], TRIALS)
    got = sequence.sobol(obs, SPECS, 2, skip=0).collect()
    every = points(spark, 6, 2)
    for r in got:
        number = r.place + (3 if r.campaign_id == 1 else 1)
        assert (r.p_x, r.p_y) == pytest.approx((10 * every[number][0], -1 + 2 * every[number][1]))
    assert sequence.sobol(obs.limit(0), SPECS, 2).count() == 0


def exact(names, own, background, model):
    d = len(names)
    worth = {s: np.mean([model(*(own[i] if i in s else b[i] for i in range(d))) for b in background]) for k in range(d + 1) for s in map(frozenset, combinations(range(d), k))}
    return [sum(math.factorial(len(s)) * math.factorial(d - len(s) - 1) / math.factorial(d) * (worth[s | {i}] - worth[s]) for s in worth if i not in s) for i in range(d)]


@pytest.mark.parametrize("d", [1, 2, 6])
def test_shapley_values_are_exact(spark, d):
    rng = random.Random(d)
    names = [f"p{i}" for i in range(d)]
    back = [tuple(rng.uniform(-1, 1) for _ in names) for _ in range(17)]
    own = [tuple(rng.uniform(-1, 1) for _ in names) for _ in range(3)]
    model = lambda *x: math.prod(1 + v for v in x) + x[0] * abs(x[-1])
    schema = ", ".join(f"{n} double" for n in names)
    rows = spark.createDataFrame([("g", i, *x) for i, x in enumerate(own)] + [("h", 9, *own[0])], f"g string, item int, {schema}")
    base = spark.createDataFrame([("g", *x) for x in back] + [("g", *[None] * d)], f"g string, {schema}")

    def column(p):
        out = F.lit(1.0)
        for n in names:
            out = out * (1 + p[n])
        return out + p[names[0]] * F.abs(p[names[-1]])

    got = explain.shapley(rows, base, "g", names, column).collect()
    assert {r.g for r in got} == {"g"} and len(got) == 3 * d
    for i, x in enumerate(own):
        found = [next(r.value for r in got if r.item == i and r.name == n) for n in names]
        assert found == pytest.approx(exact(names, x, back, model), abs=2e-6)


def test_sampled_coalitions_keep_the_whole(spark):
    names = [f"p{i}" for i in range(13)]
    schema = ", ".join(f"{n} double" for n in names)
    rows = spark.createDataFrame([(1, 1, *([1.0] * 13))], f"g int, item int, {schema}")
    base = spark.createDataFrame([(1, *([0.0] * 13)), (1, *([0.5] * 13))], f"g int, {schema}")
    got = explain.shapley(rows, base, "g", names, lambda p: sum((p[n] * (i + 1) for i, n in enumerate(names)), F.lit(0.0)), samples=80).collect()
    assert [r.value for r in sorted(got, key=lambda r: names.index(r.name))] == pytest.approx([0.75 * (i + 1) for i in range(13)], abs=1e-4)


@pytest.mark.parametrize("scaled", [False, True])
def test_directions_as_numpy(spark, scaled):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 6)) @ np.diag([5, 3, 2, 1, 0.5, 0]) @ np.linalg.qr(rng.normal(size=(6, 6)))[0] + 7
    x[:, 5] = 4.0
    rows = spark.createDataFrame([(i, v.tolist(), "clash") for i, v in enumerate(x)] + [(-1, None, ""), (-2, [1.0, None, 1.0, 1.0, 1.0, 1.0], ""), (-3, [1.0], "")], "id int, x array<double>, places string")
    got = {r.id: r.places for r in explain.project(rows.repartition(3), "x", 3, scaled=scaled).collect()}
    assert got[-1] is got[-2] is got[-3] is None
    size = np.where(x.std(axis=0, ddof=1) > 1e-9, x.std(axis=0, ddof=1), 1) if scaled else 1
    z = (x - x.mean(axis=0)) / size
    _, _, vt = np.linalg.svd(z)
    v = vt[:3] * np.sign(vt[:3][np.arange(3), np.abs(vt[:3]).argmax(axis=1)])[:, None]
    assert np.abs(np.array([got[i] for i in range(400)]) - z @ v.T).max() < 1e-6


def test_directions_by_share_and_of_few_rows(spark):
    rows = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.1 * (i % 2)]) for i in range(50)], "id int, x array<double>")
    assert {len(r.places) for r in explain.project(rows, "x", 3, share=0.99).collect()} == {1}
    assert explain.project(rows.limit(1), "x", 2).first().places == [0.0, 0.0]
    assert explain.project(rows.limit(0), "x", 2).count() == 0


def tree_by_hand(rows, level, depth, bins, leaf, node, feature_of):
    """rows: (steps, y, times). Every cut of the node's feature; {node: (feature, cut)}."""
    n, s = sum(t for *_, t in rows), sum(y * t for _, y, t in rows)
    f, best = feature_of(node), None
    for cut in range(bins):
        left = [r for r in rows if r[0][f] <= cut]
        nl, sl = sum(t for *_, t in left), sum(y * t for _, y, t in left)
        if not any(r[0][f] == cut for r in rows) or nl < leaf or n - nl < leaf or n <= leaf:
            continue
        gain = sl * sl / nl + (s - sl) ** 2 / (n - nl) - s * s / n
        if best is None or gain > best[0] + 1e-9:
            best = gain, cut
    if level == depth or best is None or best[0] <= 0:
        return {}, {node: (n, s / n)}
    splits, leaves = {node: (f, best[1])}, {}
    for child, own in ((2 * node + 1, [r for r in rows if r[0][f] <= best[1]]), (2 * node + 2, [r for r in rows if r[0][f] > best[1]])):
        a, b = tree_by_hand(own, level + 1, depth, bins, leaf, child, feature_of)
        splits |= a
        leaves |= b
    return splits, leaves


def test_forest_against_every_cut(spark):
    rng = random.Random(9)
    rows = [(c, i, rng.uniform(0, 10), rng.uniform(-1, 1), 0.0, False) for c in (1, 2) for i in range(60)]
    rows = [(c, i, x, y, round(x * x + 10 * y + rng.gauss(0, 1), 2), f) for c, i, x, y, _, f in rows] + [(3, 0, 1.0, 0.0, 5.0, False), (1, 90, 2.0, 0.0, None, False), (1, 91, 2.0, 0.0, 1e6, True)]
    obs = spark.createDataFrame(rows, TRIALS)
    splits, leaves = forest.grow(obs, SPECS, trees=3, depth=3, bins=16)
    times = {(r.t, r.campaign_id, r.iteration): r.n for t in range(3) for r in obs.select(F.lit(t).alias("t"), "campaign_id", "iteration", forest.times(F.lit(t), F.col("campaign_id"), F.col("iteration")).alias("n")).collect()}
    pick = {(r.t, r.k): (0 if r.a else 1) for t in range(3) for r in spark.range(15).select(F.lit(t).alias("t"), F.col("id").cast("int").alias("k")).select("t", "k", forest.tried(F.col("t"), F.col("k"), 0, 2).alias("a")).collect()}
    got = {(r.campaign_id, r.tree, r.node): (r.feature, r.cut) for r in splits.collect()}
    ends = {(r.campaign_id, r.tree, r.node): (r.n, r["mean"]) for r in leaves.collect()}
    step = lambda s, x: min(max(math.floor((x - s.lower) / (s.upper - s.lower) * 16), 0), 15)
    want, want_ends = {}, {}
    for c in (1, 2, 3):
        for t in range(3):
            own = [((step(SPECS[0], x), step(SPECS[1], y)), k, times[t, c, i]) for cc, i, x, y, k, f in rows if cc == c and not f and k is not None and times[t, c, i]]
            if own:
                a, b = tree_by_hand(own, 0, 3, 16, 2, 0, lambda node: pick[t, node])
                want |= {(c, t, n): v for n, v in a.items()}
                want_ends |= {(c, t, n): v for n, v in b.items()}
    assert got == want
    assert set(ends) == set(want_ends) and all(ends[k] == (want_ends[k][0], pytest.approx(want_ends[k][1])) for k in ends)
    told = forest.predict(obs.where("campaign_id < 3 AND iteration < 5").select("campaign_id", "iteration", "p_x", "p_y"), splits, leaves, SPECS, 3, 3, 16).collect()
    for r in told:
        said = []
        for t in range(3):
            node, steps = 0, (step(SPECS[0], r.p_x), step(SPECS[1], r.p_y))
            while (r.campaign_id, t, node) in want:
                f, cut = want[r.campaign_id, t, node]
                node = 2 * node + (1 if steps[f] <= cut else 2)
            said.append(want_ends[r.campaign_id, t, node][1])
        assert r.mu == pytest.approx(np.mean(said)) and r.sigma == pytest.approx(max(np.std(said, ddof=1), 1e-6))


def test_forests_in_blocks_are_those_by_levels(spark):
    rng = random.Random(12)
    rows = [(c, i, rng.uniform(-1, 11), rng.choice([-1.0, 0.0, 0.3, 1.0]), round(rng.gauss(0, 50) * 10 ** (c % 3), 3), rng.random() < 0.2) for c, size in ((1, 90), (2, 40), (3, 5), (4, 1)) for i in range(size)]
    obs = spark.createDataFrame(rows, TRIALS)
    told = [[sorted(map(tuple, part.collect())) for part in forest.grow(obs, SPECS, trees=4, depth=3, bins=16, most=most)] for most in (10**6, 0, 30)]
    assert told[0] == told[1] == told[2] and len(told[0][0]) > 20


def test_forest_suggests_where_it_is_good(spark):
    rng = random.Random(10)
    rows = [(1, i, x := rng.uniform(0, 10), rng.uniform(-1, 1), (x - 3) ** 2, False) for i in range(200)] + [(2, i, 1.0, 0.0, 1.0, i > 1) for i in range(5)]
    got = forest.suggest(spark.createDataFrame(rows, TRIALS), SPECS, n=2).collect()
    assert [r.campaign_id for r in got] == [1, 1] and all(abs(r.p_x - 3) < 2.5 for r in got)
    assert forest.suggest(spark.createDataFrame([], TRIALS), SPECS).count() == 0


def test_strengths_of_votes(spark):
    rng = random.Random(4)
    true = {"a": 8.0, "b": 4.0, "c": 2.0, "d": 1.0}
    votes = []
    for _ in range(3000):
        x, y = rng.sample("abcd", 2)
        votes.append((x, y, 1.0) if rng.random() < true[x] / (true[x] + true[y]) else (y, x, 1.0))
    odd = [("a", "a", 1.0), (None, "b", 1.0), ("b", None, 1.0), ("b", "c", 0.0), ("c", "b", None), ("a", "e", 2.0), ("b", "e", 2.0)]
    got = {r.item: r for r in prefer.strengths(spark.createDataFrame(votes + odd, "winner string, loser string, confidence double"), rounds=30).collect()}
    wins = {i: sum(c for w, l, c in votes + odd[5:] if w == i) for i in "abcde"}
    score = dict.fromkeys("abcde", 1.0)
    for _ in range(30):
        new = {i: wins[i] / sum(c / (score[w] + score[l]) for w, l, c in votes + odd[5:] if i in (w, l)) for i in "abcde"}
        score = {i: s / max(new.values()) for i, s in new.items()}
    assert set(got) == set("abcde") and got["e"].score == 0.0 and got["e"].n_votes == 2
    assert all(got[i].score == pytest.approx(score[i], abs=1e-5) and got[i].wins == wins[i] for i in "abcde")
    assert [got[i].score * 8 for i in "abcd"] == pytest.approx([8, 4, 2, 1], rel=0.25)
    assert prefer.strengths(spark.createDataFrame([], "winner string, loser string, confidence double")).count() == 0

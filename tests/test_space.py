"""Search-space operators against hand-made cases and plain Python."""

from __future__ import annotations

import math
import random
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from tallymark.functions import numeric
from tallymark.model import Spec
from tallymark.operators import space

TRIALS = "campaign_id long, iteration long, p_x double, p_y double, kpi double, is_failure boolean"


def trials(spark, rows):
    return spark.createDataFrame([(1, i, *map(float, r), False) for i, r in enumerate(rows)], TRIALS)


def test_positions_count_repeats_and_skip_nulls(spark):
    rng = random.Random(1)
    rows = [(g, rng.choice([None, 1.0, 2.0, 2.0, 7.5])) for g in range(3) for _ in range(41)] + [(9, None)]
    got = space.at_positions(spark.createDataFrame(rows, "g int, x double"), ["g"], "x", least=lambda n: n * 0, middle=lambda n: F.floor(n / 2), most=lambda n: n - 1).collect()
    assert {r.g for r in got} == {0, 1, 2}
    for r in got:
        own = sorted(x for g, x in rows if g == r.g and x is not None)
        assert (r.n, r.least, r.middle, r.most) == (len(own), own[0], own[len(own) // 2], own[-1])


def test_ranges_need_five_successes_and_a_real_cut(spark):
    specs = (Spec("p_x", 0.0, 100.0), Spec("p_y", 0.0, 4.0))
    got = space.tightened_ranges(trials(spark, [(40 + i, i % 5, 0) for i in range(21)]), specs).collect()
    assert [(r.name, r.lower, r.upper, r.confidence) for r in got] == [("p_x", 39.2, 60.8, 0.7)]
    assert space.tightened_ranges(trials(spark, [(40, 1, 0)] * 4), specs).count() == 0


def test_limits(spark):
    rows = [("CE", 104.0), ("ce", 106.0), ("ce", 120.0), ("ce", -0.1), ("rct", -0.1), ("rct", 1e9), ("what", -5.0), ("ce", None)]
    got = space.out_of_range(spark.createDataFrame(rows, "name string, value double"), {"ce": (0.0, 105.0), "rct": (0.0, float("inf"))}).collect()
    assert sorted((r.name, r.value, r.severity) for r in got) == [("ce", -0.1, "error"), ("ce", 106.0, "warning"), ("ce", 120.0, "error"), ("rct", -0.1, "error")]


def test_laws_need_all_variables(spark):
    rows = spark.createDataFrame([(1, 0, 0.4, 0.6), (1, 1, 0.4, None), (1, 2, None, 0.7)], "campaign_id long, iteration long, a double, b double")
    got = space.physical_feasibility(rows, {"a": (0.5, None), "b": (None, 0.65)}, {("a", "b"): (1.0, 1e-6)}).orderBy("iteration").collect()
    assert [(r.feasible, len(r.violations)) for r in got] == [(False, 1), (False, 2), (False, 2)]


def test_mediated_and_direct_effects_add_up(spark):
    rng = random.Random(2)
    rows = []
    for i in range(400):
        x = i % 2
        m = 3 * x + rng.gauss(0, 1)
        rows.append((x, m, 2 * m + 5 * x))
    got = space.mediation(trials(spark, rows), "p_x", "p_y", "kpi").first()
    assert got.direct == pytest.approx(5.0, abs=1e-3) and got.total == pytest.approx(got.direct + got.indirect, abs=2e-4)
    few = space.mediation(trials(spark, rows[:3]), "p_x", "p_y", "kpi").first()
    assert (few.total, few.indirect, few.direct) == (0.0, 0.0, 0.0)
    assert space.frontdoor_effect(trials(spark, [(1, 1, 4)] * 3), "p_x", "p_y", "kpi").first().effect == 4.0


def test_joint_split_sees_an_interaction(spark):
    rows = [(a, b, float(a == b)) for a in (0, 1) for b in (0, 1) for _ in range(5)]
    assert space.joint_variance(trials(spark, rows), ["p_x", "p_y"]).first().explained == 1.0
    assert space.joint_variance(trials(spark, [(0, b, b) for b in (0, 1)]), ["p_x", "p_y"]).first().explained == 0.0


def test_ranks_by_strategy(spark):
    table = spark.createDataFrame([(1, "a", 1.0, 0.0, 2.0), (1, "b", 3.0, 2.0, 2.0), (1, "c", 1.0, 0.0, 2.0)], "g int, k string, mu double, sd double, best double")
    order = lambda **how: [r.k for r in space.rank_candidates(table, "g", "k", "mu", "sd", **how).orderBy("rank").collect()]
    assert order() == ["b", "a", "c"] and order(maximize=True) == ["b", "a", "c"]
    assert order(strategy="pi", best="best") == ["a", "c", "b"] and order(strategy="ei", best="best", maximize=True)[0] == "b"
    with pytest.raises(ValueError):
        order(strategy="none")


def test_queue(spark):
    queue = spark.createDataFrame([("a", 1, ["x"], ["heat"]), ("b", 2, ["y"], None), ("c", 3, [], ["heat", "cool"]), ("d", 3, None, []), ("e", 0, ["lost"], [])], "key string, place int, deps array<string>, needs array<string>")
    done = spark.createDataFrame([("x",)], "key string")
    resources = spark.createDataFrame([("r", ["heat"], True), ("s", ["cool", "heat"], False), ("t", ["cool"], True)], "resource_id string, capabilities array<string>, available boolean")
    assert [r.key for r in space.ready_trials(queue, done, resources, 5).collect()] == ["a", "d"]
    assert [r.key for r in space.ready_trials(queue, done, resources, 1).collect()] == ["a"]


def test_quantile_and_stopping_index(spark):
    ps = [1e-6, 0.001, 0.2, 0.5, 0.8, 0.999, 1 - 1e-6]
    got = spark.createDataFrame([(p,) for p in ps], "p double").select("p", numeric.norm_ppf(F.col("p")).alias("z")).collect()
    for r in got:
        assert r.z == pytest.approx(NormalDist().inv_cdf(r.p), abs=1e-3 if r.p < 1e-4 or r.p > 1 - 1e-4 else 3e-5)
    ends = spark.range(1).select(*(numeric.norm_ppf(F.lit(p)).alias(f"c{i}") for i, p in enumerate((0.0, 1.0, 2.0))), numeric.gittins_index(F.lit(1.0), F.lit(1.0), F.lit(2.0), F.lit(4.0)).alias("g"), numeric.gittins_index(F.lit(1.0), F.lit(1.0), F.lit(0.0), F.lit(4.0)).alias("g0")).first()
    assert (ends.c0, ends.c1, ends.c2, ends.g0) == (float("-inf"), float("inf"), None, 0.0)
    assert ends.g == pytest.approx(2 / math.sqrt(2 * math.pi) / 4, abs=1e-6)

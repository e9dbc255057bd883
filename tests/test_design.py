"""Equations, discrepancy and least distance against plain Python."""

from __future__ import annotations

import math
import random
from itertools import combinations, product

import pytest
from pyspark.sql import functions as F

from tallymark.model import Spec
from tallymark.operators import design, equations

SPECS = (Spec("p_x", 0.0, 10.0), Spec("p_y", -1.0, 1.0))
TRIALS = "campaign_id long, iteration long, p_x double, p_y double, kpi double"
X, Y = ("var", "x"), ("var", "y")


def trials(seed: int = 5) -> list[tuple]:
    rng = random.Random(seed)
    rows = [(1, i, rng.choice([0.0, 2.5, 7.0, 10.0]), rng.uniform(-1, 1), 1.0) for i in range(40)]
    rows += [(2, i, rng.uniform(0, 10), rng.uniform(-1, 1), 1.0) for i in range(61)]
    # Crowded in one corner, and some beyond the bounds.
    rows += [(3, i, 9 + rng.gauss(0, 1) * 10 ** -rng.randint(0, 6), 1 + rng.gauss(0, 0.001), 1.0) for i in range(50)]
    rows += [(4, 0, 3.0, 0.5, 1.0), (5, 0, 1.0, 0.0, 1.0), (5, 1, 1.0, 0.0, 2.0), (5, 2, 9.0, 0.0, 2.0)]
    return rows + [(5, 3, None, 0.0, 1.0), (5, 4, math.nan, 0.0, 1.0), (6, 0, 1.0, None, 1.0)]


def whole(rows: list[tuple]) -> dict[int, list[tuple[float, float]]]:
    out: dict[int, list[tuple[float, float]]] = {}
    for c, _, x, y, _ in rows:
        if x is not None and y is not None and math.isfinite(x):
            out.setdefault(c, []).append(((x - 0.0) / 10.0, (y + 1.0) / 2.0))
    return out


def test_star_discrepancy_counts_every_box(spark):
    got = {r.campaign_id: r for r in design.star_discrepancy(spark.createDataFrame(trials(), TRIALS), SPECS).collect()}
    want = whole(trials())
    assert set(got) == set(want)
    for c, points in want.items():
        ends = [sorted({p[i] for p in points} | ({1.0} if max(p[i] for p in points) < 1 else set())) for i in (0, 1)]
        worst = max(abs(sum(p[0] <= a and p[1] <= b for p in points) / len(points) - a * b) for a, b in product(*ends))
        assert got[c].n_trials == len(points) and got[c].discrepancy == pytest.approx(worst)


@pytest.mark.parametrize("seed", range(3))
def test_least_distance_is_that_of_all_pairs(spark, seed):
    got = {r.campaign_id: r for r in design.least_distance(spark.createDataFrame(trials(seed), TRIALS).repartition(3), SPECS).collect()}
    for c, points in whole(trials(seed)).items():
        least = min((math.dist(a, b) for a, b in combinations(points, 2)), default=None)
        assert got[c].n_trials == len(points) and got[c].distance == (None if least is None else pytest.approx(least, rel=1e-9))


@pytest.mark.parametrize("measure, limit", [("star_discrepancy", "CELLS"), ("least_distance", "PLACES")])
def test_small_designs_stay_in_their_task_and_large_ones_are_dealt(spark, monkeypatch, measure, limit):
    table = spark.createDataFrame(trials(), TRIALS)
    whole_plan = getattr(design, measure)(table, SPECS)
    plan = whole_plan._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "Window" not in plan and "Generate" not in plan
    told = sorted(map(tuple, whole_plan.collect()))
    # 0: every campaign is large; 150: some are (campaigns 1 to 3 have 40 to 61 places).
    for most in (0, 45, 150):
        monkeypatch.setattr(design, limit, most)
        dealt = sorted(map(tuple, getattr(design, measure)(table, SPECS).collect()))
        assert [r[:2] for r in dealt] == [r[:2] for r in told]
        assert [r[2] for r in dealt] == [None if r[2] is None else pytest.approx(r[2], rel=1e-12) for r in told]


def test_designs_without_trials(spark):
    none = spark.createDataFrame([], TRIALS + ", n_trials string, copies int, u0 int")
    assert design.star_discrepancy(none, SPECS).count() == design.least_distance(none, SPECS).count() == 0
    fixed = (Spec("p_x", 4.0, 4.0), SPECS[1])
    clash = spark.createDataFrame([(1, 0, 4.0, 0.0, 1.0, "a", 1), (1, 1, 4.0, 1.0, 1.0, "b", 1)], TRIALS + ", n_trials string, copies int")
    assert design.least_distance(clash, fixed).first().distance == 0.5
    assert design.star_discrepancy(clash, fixed).first().discrepancy == pytest.approx(0.5)


@pytest.mark.parametrize(
    "tree, want, shown, nodes",
    [
        (("const", 3.14), 3.14, "3.14", 1),
        (("const", 3.0), 3.0, "3", 1),
        (X, 4.0, "x", 1),
        (("+", X, ("*", ("const", 2.0), Y)), 1.0, "(x + (2 * y))", 5),
        (("/", X, ("-", Y, Y)), math.inf, "(x / (y - y))", 5),
        (("exp", ("const", 501.0)), math.inf, "exp(501)", 2),
        (("log", ("abs", Y)), math.log(1.5), "log(abs(y))", 3),
        (("log", Y), math.inf, "log(y)", 2),
        (("sqrt", Y), math.inf, "sqrt(y)", 2),
        (("neg", ("sqrt", X)), -2.0, "neg(sqrt(x))", 3),
        (("*", ("exp", ("const", 499.0)), ("exp", ("const", 499.0))), math.inf, "(exp(499) * exp(499))", 5),
        (("+", ("const", 1.0), ("var", "none")), math.inf, "(1 + none)", 3),
        (("abs", ("var", "nan")), math.inf, "abs(nan)", 2),
    ],
)
def test_trees(spark, tree, want, shown, nodes):
    import numpy as np

    rows = spark.createDataFrame([(4.0, -1.5, None, math.nan)], "x double, y double, none double, nan double")
    got = rows.select(equations.value(tree).alias("v")).first().v
    data = {"x": np.array([4.0]), "y": np.array([-1.5]), "none": np.array([np.nan]), "nan": np.array([np.nan])}
    with np.errstate(all="ignore"):
        batch = float(equations.values(tree, data, {})[0])
    assert got == pytest.approx(want) and (math.isnan(batch) if want == math.inf else batch == pytest.approx(want))
    assert equations.text(tree) == shown and equations.complexity(tree) == nodes


def test_a_planted_law_is_found(spark):
    rng = random.Random(1)
    rows = [(rng.uniform(1, 5), rng.uniform(-2, 2), rng.uniform(0, 1)) for _ in range(600)]
    data = spark.createDataFrame(rows, "x double, y double, z double").withColumn("t", 7 - 3 * F.col("x") * F.exp("y") / (F.col("z") + 1))
    broken = spark.createDataFrame([(1.0, 1.0, 1.0, None), (None, 1.0, 1.0, 1.0), (1.0, math.nan, 1.0, 1.0)], "x double, y double, z double, t double")
    front = equations.discover(data.unionByName(broken).repartition(5), ["x", "y", "z"], "t", beam=6, operations=("+", "*", "/", "exp")).collect()
    last = front[-1]
    assert last.mse < 1e-12 and last.complexity <= 8
    assert (last.offset, abs(last.scale)) == (pytest.approx(7), pytest.approx(3))
    assert [r.complexity for r in front] == sorted({r.complexity for r in front}) and [r.mse for r in front] == sorted((r.mse for r in front), reverse=True)
    # The scores of the short equations are those of least squares.
    import numpy as np

    t = np.array([7 - 3 * x * math.exp(y) / (z + 1) for x, y, z in rows])
    leaves = [np.polyfit(np.array([r[i] for r in rows]), t, 1, full=True)[1][0] / len(rows) for i in range(3)]
    assert front[0].equation in "xyz" and front[0].mse == pytest.approx(min(leaves))


def test_no_rows_and_no_spread_have_an_equation_or_none(spark):
    data = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (3.0, 2.0)], "x double, t double")
    flat = equations.discover(data, ["x"], "t", levels=2, beam=2).collect()
    assert len(flat) == 1 and flat[0].complexity == 1 and flat[0].mse == pytest.approx(0)
    assert equations.discover(data.where("x > 9"), ["x"], "t").count() == 0


def test_joined_trees_are_scored_without_their_values(spark, monkeypatch):
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(5)
    x, y, z = rng.uniform(900, 1e5, 5000), rng.uniform(0, 0.1, 5000), rng.uniform(1e5, 2e6, 5000)
    y[7] = 0.0
    z[4999] = 1e9  # by itself it takes (z * x) over the limit, in the second slice of rows only
    batch = pa.RecordBatch.from_pydict({"x": x, "y": y, "z": z, "t": x * (1 - y)})
    leaves = [("var", v) for v in "xyz"] + [("const", 1.0)]
    best = [leaves[0], ("-", leaves[3], leaves[1]), ("exp", leaves[1])]
    shared = leaves + best[1:] + [("+", leaves[0], leaves[1])]
    trees = [("log", best[1])] + [t for a in best for b in shared for o in equations.BINARY for t in ((o, a, b), (o, b, a))]

    class Rows:
        columns = ["x", "y", "z", "t"]

        def mapInArrow(self, add, schema):
            return spark.createDataFrame(pa.Table.from_batches(add(iter([batch]))))

    made, values = [], equations.values
    monkeypatch.setattr(equations, "values", lambda tree, *rest: (made.append(tree), values(tree, *rest))[1])
    want = equations._scores(Rows(), "t", trees, shared, 1e12)
    by_rows = len(made)
    made.clear()
    got = equations._scores(Rows(), "t", trees, shared, 1e12, best)
    assert len(made) < 0.6 * by_rows
    broken = {equations.text(t) for t, s in zip(trees, got) if math.isinf(s[0])}
    assert broken == {equations.text(t) for t, s in zip(trees, want) if math.isinf(s[0])} and {"(x * z)", "(x / y)"} <= broken and "(1 / z)" not in broken
    # Trees that hardly vary (x + y over x) are noise in sums of squares either way.
    sd = lambda v: np.std(v) / np.sqrt(np.mean(v * v))
    data = {n: batch.column(n).to_numpy() for n in Rows.columns}
    for t, a, b in zip(trees, got, want):
        if math.isfinite(b[0]) and (b[2] == 0 or sd(np.broadcast_to(values(t, data, {}), x.shape)) > 1e-3):
            assert a[0] == pytest.approx(b[0], rel=1e-6, abs=1e-3) and a[2] == pytest.approx(b[2], rel=1e-6), equations.text(t)

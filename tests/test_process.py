"""Gaussian processes in blocks against numpy on whole matrices."""

from __future__ import annotations

import numpy as np
import pytest

from tallymark.operators import process

SCHEMA = "g string, id int, a double, b double, y double, noise double, x string, kind int"


def covariance(kernel, a, b):
    gap = ((a[:, None] - b[None]) ** 2).sum(axis=2) / kernel.length**2
    far = np.sqrt(5 * gap)
    return kernel.signal * (np.exp(-gap / 2) if kernel.name == "rbf" else (1 + far + 5 * gap / 3) * np.exp(-far))


def fitted(kernel, x, y, noise, at):
    inverse = np.linalg.inv(covariance(kernel, x, x) + np.diag(noise))
    cross = covariance(kernel, at, x)
    return cross @ inverse @ y, kernel.signal - np.einsum("ij,jk,ik->i", cross, inverse, cross)


@pytest.fixture(scope="module")
def made(spark):
    rng = np.random.default_rng(5)
    groups = {"many": 14, "one block": 4, "two": 2, "full": 10}
    rows = [(g, i, *rng.random(2).tolist(), float(rng.normal() + (9 if i == 3 else 0)), float(rng.choice([0.01, 0.3])), "clash", 1) for g, n in groups.items() for i in range(n)]
    rows += [("many", 14, *rows[0][2:]), ("many", 15, None, 0.5, 1.0, 0.1, "", 0), ("many", 16, 0.5, 0.5, float("nan"), 0.1, "", 0), ("none", 0, 0.5, 0.5, None, None, None, None)]
    held = {}
    for g, i, a, b, y, noise, *_ in rows:
        if a is not None and y is not None and y == y:
            held.setdefault(g, []).append((i, (a, b), y, noise))
    return spark.createDataFrame(rows, SCHEMA), held


def columns(held):
    return [np.array(c) for c in zip(*held)]


@pytest.mark.parametrize("block", [5, 512])
def test_each_row_left_out(made, block):
    rows, held = made
    kernel = process.Kernel("rbf", 0.4, 1.5)
    got = {(r.g, r.id): r for r in process.leave_one_out(rows, "g", "id", ["a", "b"], "y", kernel, 0.1, block).collect()}
    assert set(got) == {(g, i) for g, v in held.items() if len(v) > 2 for i, *_ in v}
    for (g, i), r in got.items():
        ids, x, y, _ = columns(held[g])
        rest = ids != i
        mu, var = fitted(kernel, x[rest], y[rest], np.full(rest.sum(), 0.1), x[~rest])
        assert (r.mu, r.sigma**2) == pytest.approx((mu[0], var[0] + 0.1), rel=1e-6, abs=1e-9)
        assert r.residual == pytest.approx(abs(y[~rest][0] - mu[0]) / np.sqrt(var[0] + 0.1), rel=1e-6)


def test_outliers_hold_the_planted_ones(made):
    """A planted value also makes its neighbours look odd, but none of them as odd as itself."""
    rows, _ = made
    found = process.outliers(rows, "g", "id", ["a", "b"], "y", 4.0, kernel=process.Kernel("rbf", 0.4), noise=0.5).collect()
    worst = {g: max((r for r in found if r.g == g), key=lambda r: r.residual).id for g in {r.g for r in found}}
    assert {"many", "full"} <= set(worst) and set(worst.values()) == {3} and all(r.residual > 4.0 for r in found)


@pytest.mark.parametrize("block", [5, 512])
def test_rows_count_by_their_noise(made, spark, block):
    rows, held = made
    kernel = process.Kernel("matern52", 0.7, 2.0)
    rng = np.random.default_rng(6)
    at = {g: rng.random((7, 2)) for g in [*held, "none"]}
    points = spark.createDataFrame([(g, i, *p.tolist(), 0) for g, v in at.items() for i, p in enumerate(v)] + [("many", 99, None, 0.1, 0)], "g string, place_no int, a double, b double, r int")
    got = {(r.g, r.place_no): (r.mu, r.var) for r in process.predict(rows, points, "g", "id", "place_no", ["a", "b"], "y", kernel, "noise", block).collect()}
    assert len(got) == 7 * len(at)
    for g, v in at.items():
        want = list(zip(*fitted(kernel, *columns(held[g])[1:], v))) if g in held else [(0.0, 2.0)] * 7
        for i in range(7):
            assert got[g, i] == pytest.approx(want[i], rel=1e-6, abs=1e-8)


def test_noise_impact(made):
    rows, held = made
    kernel = process.Kernel("matern52", 0.7)
    got = {r.id: r for r in process.noise_impact(rows, "g", "id", ["a", "b"], "y", "noise", kernel).where("g = 'many'").collect()}
    ids, x, y, noise = columns(held["many"])
    weight = lambda n: np.abs(np.linalg.solve(covariance(kernel, x, x) + np.diag(n), y))
    own, mean = weight(noise), weight(np.full(len(y), noise.mean()))
    for i, o, m in zip(ids, own, mean):
        assert (got[i].own_weight, got[i].mean_weight, got[i].ratio) == pytest.approx((o, m, o / m), rel=1e-5)


def test_nothing_to_learn_from(made):
    rows, _ = made
    empty = rows.where("false")
    assert process.leave_one_out(empty, "g", "id", ["a", "b"], "y").count() == 0
    assert [(r.mu, r["var"]) for r in process.predict(empty, rows.where("id = 0 AND g = 'many'"), "g", "id", "id", ["a", "b"], "y").collect()] == [(0.0, 1.0)]


def test_entropy_changes(spark):
    rng = np.random.default_rng(8)
    series = {0: np.r_[rng.normal(0, 1, 40), rng.normal(0, 9, 20)], 1: np.zeros(30), 2: np.arange(5.0), 3: rng.normal(0, 1, 7)}
    rows = spark.createDataFrame([(g, i, float(v)) for g, s in series.items() for i, v in enumerate(s)] + [(0, 99, None)], "g int, i int, y double")
    want = set()
    for g, s in series.items():
        spread = [np.var(s[i : i + 5]) for i in range(len(s) - 4)]
        change = np.abs(np.diff(spread))
        if len(change) and change.std() > 1e-12:
            want |= {(g, i + 5, float(c / change.std())) for i, c in enumerate(change) if c > 2 * change.std()}
    got = sorted(tuple(r) for r in process.entropy_changes(rows, "g", "i", "y").collect())
    assert want and len(got) == len(want)
    for g, w in zip(got, sorted(want)):
        assert g == pytest.approx(w, abs=1e-5)


def test_residual_outliers(spark):
    rows = spark.createDataFrame([(0, 1.0, 0.0, 0.2), (1, 1.0, 0.9, 0.2), (2, 1.0, 5.0, 0.0), (3, None, 5.0, 0.1), (4, -1.0, 0.0, 0.25)], "id int, y double, mu double, sigma double")
    assert {(r.id, r.residual) for r in process.residual_outliers(rows, "y", "mu", "sigma").collect()} == {(0, 5.0), (4, 4.0)}


@pytest.mark.parametrize("n", [1, 64, 65, 300])
def test_inverse_by_halves(n):
    lower = np.linalg.cholesky(process.Kernel("matern52", 0.5).between(x := np.random.default_rng(n).random((n, 3)), x) + 0.1 * np.eye(n))
    told = process.lower_inverse(lower)
    assert np.abs(told @ lower - np.eye(n)).max() < 1e-10 and (np.triu(told, 1) == 0).all()

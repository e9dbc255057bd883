"""Curve features against plain Python, and sensitivity where nothing varies."""

from __future__ import annotations

import random

import pytest

from tallymark.model import Spec
from tallymark.operators import adjust, spectra

CURVES = "id int, x array<double>, y array<double>, points string"


def made(rng):
    n = rng.choice([1, 2, 3, 7, 30, 64])
    kind = rng.random()
    if kind < 0.2:
        y = [rng.choice([0.0, 1.0]) for _ in range(n)]
    elif kind < 0.3:
        y = [2.0] * n
    else:
        y = [rng.gauss(0, 1) + (5 if i % 9 == 4 else 0) for i in range(n)]
    return sorted(rng.uniform(0, 9) for _ in range(n)) if kind < 0.7 else [rng.uniform(-1, 9) for _ in range(n)], y


def lowest(y, share):
    k = max(1, len(y) // share)
    return sum(sorted(y)[:k]) / k


def area(x, y):
    return sum(0.5 * abs(x[i + 1] - x[i]) * (y[i] + y[i + 1]) for i in range(len(x) - 1))


def width(x, y, peak, level, left, right):
    a = next((x[i] for i in range(peak, -1, -1) if y[i] <= level), left)
    b = next((x[i] for i in range(peak, len(y)) if y[i] <= level), right)
    return abs(b - a)


def impedance(x, y):
    n = len(x)
    start = max(1, n - max(1, n // 5))
    slope = (y[-1] - y[start]) / (x[-1] - x[start]) if start < n - 1 and x[-1] != x[start] else 0.0
    return min(x), max(x), max(x) - min(x), max(y), x[y.index(max(y))], slope


def absorbance(x, y):
    peak, base = y.index(max(y)), lowest(y, 10)
    return x[peak], y[peak], width(x, y, peak, base + (y[peak] - base) / 2, x[0], x[-1]), area(x, y), base, y[peak] - base


def diffraction(x, y):
    n, base = len(x), lowest(y, 5)
    least = (max(y) - base) * 0.1
    peaks = [i for i in range(n) if n > 1 and (i == 0 or y[i] > y[i - 1]) and (i == n - 1 or y[i] > y[i + 1]) and y[i] - base > least] or [y.index(max(y))]
    best = max(peaks, key=lambda i: (y[i], -i))
    widths = [width(x, y, p, base + (y[p] - base) / 2, x[max(0, p - 1)], x[min(n - 1, p + 1)]) for p in peaks]
    whole = area(x, y)
    return x[best], y[best], len(peaks), area(x, [max(0.0, v - base) for v in y]) / whole if whole > 0 else 0.0, sum(widths) / len(widths), base


@pytest.mark.parametrize("found,want", [(spectra.impedance, impedance), (spectra.absorbance, absorbance), (spectra.diffraction, diffraction)])
def test_curves(spark, found, want):
    rng = random.Random(12)
    curves = [made(rng) for _ in range(150)]
    rows = [(i, x, y, "clash") for i, (x, y) in enumerate(curves)] + [(-1, [], [], ""), (-2, None, None, ""), (-3, [1.0, None, 2.0], [4.0, 5.0, None], "")]
    got = {r.id: tuple(r)[1:] for r in found(spark.createDataFrame(rows, CURVES), ["id"], "x", "y").collect()}
    assert len(got) == len(rows) and got[-1] == got[-2] == (0.0,) * 6
    for i, (x, y) in [*enumerate(curves), (-3, ([1.0], [4.0]))]:
        assert got[i] == pytest.approx(want(x, y), abs=2e-6), (x, y)


def test_sensitivity_where_nothing_varies(spark):
    schema = "campaign_id int, iteration int, p_x double, p_y double, kpi double, is_failure boolean"
    rows = [(1, i, float(i), 1.0, 5.0, False) for i in range(6)] + [(2, i, float(i), 1.0, 2.0 * i, False) for i in range(6)]
    got = {(r.campaign_id, r.name): r for r in adjust.sensitivity(spark.createDataFrame(rows, schema), (Spec("p_x", 0.0, 10.0), Spec("p_y", 0.0, 2.0))).collect()}
    assert got[1, "p_x"].local_gradient == 0.0 and got[1, "p_x"].score == 0.0 and got[2, "p_x"].local_gradient > 0

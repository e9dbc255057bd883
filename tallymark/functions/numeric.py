"""Guarded statistics and acquisition functions as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-12


def tidy(x: Column, digits: int = 6) -> Column:
    """Rounded, and never minus zero."""
    return F.round(x, digits) + F.lit(0.0)


def safe_corr(x: Column, y: Column, when: Column | None = None) -> Column:
    """Pearson correlation as an aggregate; 0 where either side is constant."""
    if when is not None:
        x, y = F.when(when, x), F.when(when, y)
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    sd = F.stddev_pop(a) * F.stddev_pop(b)
    return F.coalesce(F.when(sd > TINY, F.covar_pop(a, b) / sd), F.lit(0.0))


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def norm_pdf(x: Column) -> Column:
    return F.exp(-x * x / 2) / math.sqrt(2 * math.pi)


def norm_logpdf(x: Column) -> Column:
    return -x * x / 2 - 0.5 * math.log(2 * math.pi)


def norm_cdf(x: Column) -> Column:
    """Within 7.5e-8 of the normal distribution function (Abramowitz and Stegun 26.2.17), without leaving the JVM."""
    # The polynomial's coefficients.
    rates = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
    t = 1 / (1 + 0.2316419 * F.abs(x))
    poly = F.lit(0.0)
    for c in reversed(rates):
        poly = (poly + c) * t
    upper = norm_pdf(x) * poly
    return F.when(x >= 0, 1 - upper).otherwise(upper)


def norm_ppf(p: Column) -> Column:
    """The normal quantile, within 3e-5 for p in [0.001, 0.999] and 1e-3 down to 1e-6 of either end; infinite at 0 and 1, null beyond.

    A rational first guess (Abramowitz and Stegun 26.2.23) and two Newton steps on ``norm_cdf``.
    """
    tail = F.least(p, 1 - p)
    t = F.sqrt(-2 * F.ln(tail))
    # The coefficients of the guess.
    x = -(t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t * t * t))
    for _ in range(2):
        x = x - (norm_cdf(x) - tail) / norm_pdf(x)
    inner = F.when(p < 0.5, x).when(p > 0.5, -x).otherwise(0.0)
    return F.when((p > 0) & (p < 1), inner).when(p == 0, float("-inf")).when(p == 1, float("inf"))


def gittins_index(best: Column, mean: Column, std: Column, cost: Column) -> Column:
    """Expected excess of one more trial for each unit of its cost; at or below 0 stop.  0 without spread or cost."""
    z = (mean - best) / std
    return F.when((std <= 0) | (cost <= 0), 0.0).otherwise((norm_pdf(z) - z * (1 - norm_cdf(z))) * std / cost)


def binary_entropy(p: Column) -> Column:
    """Bits; 0 at and beyond the ends."""
    return F.when((p <= 0) | (p >= 1), F.lit(0.0)).otherwise(-p * F.log2(p) - (1 - p) * F.log2(1 - p))


def expected_improvement(mu: Column, sigma: Column, best: Column) -> Column:
    """Of a minimiser."""
    z = (best - mu) / sigma
    return F.when(sigma <= TINY, F.greatest(best - mu, F.lit(0.0))).otherwise((best - mu) * norm_cdf(z) + sigma * norm_pdf(z))


def upper_confidence_bound(mu: Column, sigma: Column, kappa: float = 2.0) -> Column:
    """Lower is better."""
    return mu - kappa * sigma


def probability_of_improvement(mu: Column, sigma: Column, best: Column) -> Column:
    return F.when(sigma <= TINY, (mu < best).cast("double")).otherwise(norm_cdf((best - mu) / sigma))


def log_expected_improvement_per_cost(ei: Column, cost: Column) -> Column:
    """ln(EI) - ln(cost); minus infinity where either is not positive."""
    return F.when((ei > 0) & (cost > 0), F.ln(ei) - F.ln(cost)).otherwise(F.lit(float("-inf")))


def cost_adjusted_acquisition(acquisition: Column, cost: Column) -> Column:
    """ln(acquisition) / cost; minus infinity where the acquisition is not positive."""
    return F.when(acquisition > 0, F.ln(acquisition) / cost).otherwise(F.lit(float("-inf")))


def rbf_kernel(a: Column, b: Column, length_scale: float = 1.0) -> Column:
    return F.exp(-squared_distance(a, b) / (2 * length_scale**2))


def matern52_kernel(a: Column, b: Column, length_scale: float = 1.0) -> Column:
    d = F.sqrt(squared_distance(a, b)) * (math.sqrt(5) / length_scale)
    return (1 + d + d * d / 3) * F.exp(-d)


def squared_distance(a: Column, b: Column) -> Column:
    """Of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

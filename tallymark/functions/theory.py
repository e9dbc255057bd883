"""Process models, kernels, encodings and cost-aware acquisition functions as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import norm_cdf, norm_pdf

GAS_CONSTANT = 8.314


def arrhenius(temperature: Column, factor: float, energy: float, gas: float = GAS_CONSTANT) -> Column:
    """Rate at an absolute temperature; 0 at or below zero."""
    return F.when(temperature > 0, factor * F.exp(F.greatest(-energy / (gas * temperature), F.lit(-700.0)))).otherwise(0.0)


def michaelis_menten(substrate: Column, most: float, half: float) -> Column:
    return F.when(F.abs(half + substrate) < 1e-15, 0.0).otherwise(most * substrate / (half + substrate))


def power_law(x: Column, factor: float, exponent: float) -> Column:
    """factor * x ** exponent; a broken exponent of a negative x keeps the sign of x."""
    if exponent == int(exponent):
        return factor * F.pow(x, F.lit(float(exponent)))
    return F.when(x < 0, -factor * F.pow(-x, F.lit(exponent))).otherwise(factor * F.pow(x, F.lit(exponent)))


def periodic_kernel(a: Column, b: Column, length_scale: float = 1.0, period: float = 1.0) -> Column:
    """exp(-2 sum sin^2(pi |a - b| / period) / length_scale^2) of two arrays."""
    waves = F.zip_with(a, b, lambda x, y: F.pow(F.sin(math.pi * F.abs(x - y) / max(abs(period), 1e-12)), F.lit(2.0)))
    return F.exp(-2.0 * F.aggregate(waves, F.lit(0.0), lambda s, x: s + x) / max(length_scale, 1e-12) ** 2)


def on_sphere(latitude: Column, longitude: Column) -> Column:
    """The point of the unit sphere at a place given in degrees."""
    lat, lon = F.radians(latitude), F.radians(longitude)
    return F.array(F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon), F.sin(lat))


def from_sphere(point: Column) -> Column:
    """Latitude and longitude in degrees of the direction of a point; (0, 0) for the centre."""
    x, y, z = (F.get(point, F.lit(i)) for i in range(3))
    size = F.sqrt(x * x + y * y + z * z)
    near = size < 1e-12
    lat = F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), z / size))))
    return F.struct(F.when(near, 0.0).otherwise(lat).alias("latitude"), F.when(near, 0.0).otherwise(F.degrees(F.atan2(y / size, x / size))).alias("longitude"))


def cost_aware_improvement(mean: Column, variance: Column, best: Column, cost: Column, fidelity: Column | None = None, margin: float = 0.01) -> Column:
    """Expected improvement of a minimum per cost, weighed by the fidelity if there is one; 0 without cost or spread."""
    sigma = F.sqrt(F.greatest(variance, F.lit(0.0)))
    gain = best - mean - margin
    value = F.greatest(gain * norm_cdf(gain / sigma) + sigma * norm_pdf(gain / sigma), F.lit(0.0)) / cost
    sound = (cost > 0) & (sigma >= 1e-12)
    if fidelity is not None:
        value, sound = value * fidelity, sound & (fidelity > 0)
    return F.when(sound, value).otherwise(0.0)


def stopping_index(best: Column, mean: Column, sigma: Column, cost: Column) -> Column:
    """Expected gain per cost of one more trial: above 0 it is worth its cost."""
    z = (mean - best) / sigma
    return F.when((sigma > 0) & (cost > 0), (norm_pdf(z) - z * (1 - norm_cdf(z))) * sigma / cost).otherwise(0.0)

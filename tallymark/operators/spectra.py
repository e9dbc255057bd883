"""Features of measured curves: impedance arcs, absorbance spectra and diffraction patterns, as column expressions.

A curve is two arrays of equal length, x and y; every row is worked on by itself, so nothing is shuffled and any number of curves
passes in one scan.  A null or empty curve has zeros for all features.  Points with a null are left out first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import tidy


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def _curves(table: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """The keys, the points' xs and ys, their number n, and the first place (from 1) of the largest y."""
    points = F.filter(F.arrays_zip(F.coalesce(F.col(x).cast("array<double>"), F.array().cast("array<double>")).alias("x"), F.coalesce(F.col(y).cast("array<double>"), F.array().cast("array<double>")).alias("y")), lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    rows = table.select(*keys, points.alias("points"))
    rows = rows.select(*keys, F.transform("points", lambda p: p["x"]).alias("xs"), F.transform("points", lambda p: p["y"]).alias("ys"))
    rows = rows.withColumn("n", F.size("ys")).withColumn("top", F.array_max("ys"))
    return rows.withColumn("at", F.array_position("ys", F.col("top")).cast("int"))


def _x(i: Column) -> Column:
    return F.try_element_at("xs", i)


def _y(i: Column) -> Column:
    return F.try_element_at("ys", i)


def _area(above: Column | float | None = None) -> Column:
    """The area under the curve by trapezoids, or under what of it is above a level."""
    high = (lambda i: _y(i)) if above is None else (lambda i: F.greatest(F.lit(0.0), _y(i) - above))
    steps = F.when(F.col("n") >= 2, F.sequence(F.lit(1), F.col("n") - 1)).otherwise(F.array().cast("array<int>"))
    return _sum(F.transform(steps, lambda i: 0.5 * F.abs(_x(i + 1) - _x(i)) * (high(i) + high(i + 1))))


def _lowest(share: int) -> Column:
    """The mean of the lowest ``1 / share`` of the ys, of one at least."""
    most = F.greatest(F.lit(1), F.floor(F.col("n") / share)).cast("int")
    return F.when(F.col("n") > 0, _sum(F.slice(F.sort_array("ys"), F.lit(1), most)) / most)


def _width(peak: Column, level: Column, left: Column, right: Column) -> Column:
    """How far apart the nearest points at or below ``level`` on both sides of a peak are; where there is none, ``left`` or ``right`` serves."""
    before = F.filter(F.sequence(F.lit(1), peak), lambda i: _y(i) <= level)
    behind = F.filter(F.sequence(peak, F.col("n")), lambda i: _y(i) <= level)
    return F.abs(F.coalesce(_x(F.get(behind, F.lit(0))), right) - F.coalesce(_x(F.get(before, F.size(before) - 1)), left))


def _features(rows: DataFrame, keys: list[str], **features: Column) -> DataFrame:
    return rows.select(*keys, *(tidy(F.coalesce(F.when(F.col("n") > 0, v), F.lit(0.0)).cast("double")).alias(k) for k, v in features.items()))


def impedance(table: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Of an arc of real against negated imaginary impedance: its ends, width and apex, and the slope of its last fifth."""
    rows = _curves(table, keys, x, y)
    n = F.col("n")
    start = F.greatest(F.lit(1), n - F.greatest(F.lit(1), F.floor(n / 5)).cast("int")) + 1
    slope = F.when(start < n, F.try_divide(_y(n) - _y(start), _x(n) - _x(start)))
    low, high = F.array_min("xs"), F.array_max("xs")
    return _features(rows, keys, r_solution=low, r_polarization=high, semicircle_diameter=high - low, max_imaginary=F.col("top"), peak_frequency_position=_x(F.col("at")), low_freq_tail_slope=slope)


def absorbance(table: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Of a spectrum: its largest peak, that peak's width at half its height over the base (the mean of the lowest tenth), and the whole area."""
    rows = _curves(table, keys, x, y).withColumn("base", _lowest(10))
    height = F.col("top") - F.col("base")
    width = _width(F.col("at"), F.col("base") + height / 2, _x(F.lit(1)), _x(F.col("n")))
    return _features(rows, keys, peak_wavelength=_x(F.col("at")), peak_absorbance=F.col("top"), fwhm=F.when(F.col("n") > 0, width), total_absorbance=_area(), baseline_level=F.col("base"), peak_prominence=height)


def diffraction(table: DataFrame, keys: list[str], x: str, y: str, prominence: float = 0.1) -> DataFrame:
    """Of a pattern: its peaks over the background (the mean of the lowest fifth), their mean width, and the share of the area above it.

    A peak is a point higher than its neighbours and over the background by more than ``prominence`` of the highest; without any, the
    highest point is the peak.
    """
    rows = _curves(table, keys, x, y).withColumn("base", _lowest(5))
    least = (F.col("top") - F.col("base")) * prominence
    # A place before the first is never looked at: element 0 of an array is an error.
    inner = F.filter(F.sequence(F.lit(2), F.col("n")), lambda i: (_y(i) > _y(i - 1)) & ((i == F.col("n")) | (_y(i) > _y(i + 1))) & (_y(i) - F.col("base") > least))
    first = F.when((_y(F.lit(1)) > _y(F.lit(2))) & (_y(F.lit(1)) - F.col("base") > least), F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))
    found = F.when(F.col("n") >= 2, F.concat(first, inner))
    rows = rows.withColumn("peaks", F.when(F.size(found) > 0, found).otherwise(F.array("at")))
    rows = rows.withColumn("best", F.array_max(F.transform("peaks", lambda i: F.struct(_y(i).alias("y"), (-i).alias("i")))))
    half = lambda i: F.col("base") + (_y(i) - F.col("base")) / 2
    widths = F.transform("peaks", lambda i: _width(i, half(i), _x(F.greatest(F.lit(1), i - 1)), _x(F.least(F.col("n"), i + 1))))
    crystal = F.when(_area() > 0, _area(F.col("base")) / _area())
    return _features(rows, keys, primary_peak_angle=_x(-F.col("best.i")), primary_peak_intensity=F.col("best.y"), n_peaks=F.size("peaks"), crystallinity_index=crystal, mean_peak_width=F.when(F.col("n") > 0, _sum(widths) / F.size("peaks")), background_level=F.col("base"))

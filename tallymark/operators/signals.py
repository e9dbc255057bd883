"""Raw signals and curves as array columns: quality checks and features, each row on its own.

A curve is two arrays of equal length, ``x`` and ``y``; a missing or empty curve has null checks and zero features.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import tidy


def _pairs(y: Column, f) -> Column:
    """``f`` of each neighbouring pair of an array."""
    n = F.size(y)
    return F.when(n >= 2, F.zip_with(F.slice(y, 1, n - 1), F.slice(y, 2, n - 1), f))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def _share(values: Column) -> Column:
    """Share of true entries of an array of booleans."""
    return F.when(F.size(values) > 0, F.size(F.filter(values, lambda v: v)) / F.size(values))


def curve_features(table: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Peak and its place (the first), area by trapezoids, mean slope, ends, range and deviation."""
    xs, ys = F.col(x), F.col(y)
    n = F.size(ys)
    peak = F.array_max(ys)
    at = F.array_position(ys, peak).cast("int")
    steps = F.when(n >= 2, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.struct((F.element_at(xs, i + 1) - F.element_at(xs, i)).alias("dx"), F.element_at(ys, i).alias("a"), F.element_at(ys, i + 1).alias("b"))))
    area = _sum(F.transform(steps, lambda s: 0.5 * F.abs(s["dx"]) * (s["a"] + s["b"])))
    slopes = F.filter(steps, lambda s: s["dx"] != 0)
    slope = F.try_divide(_sum(F.transform(slopes, lambda s: (s["b"] - s["a"]) / s["dx"])), F.size(slopes))
    mean = F.try_divide(_sum(ys), n)
    rows = table.withColumn("mean_", mean)
    deviation = F.sqrt(F.try_divide(_sum(F.transform(ys, lambda v: (v - F.col("mean_")) * (v - F.col("mean_")))), n))
    none = F.lit(0.0)
    return rows.select(
        *keys,
        tidy(F.coalesce(peak, none)).alias("peak_value"),
        tidy(F.coalesce(F.try_element_at(xs, at), none)).alias("peak_position"),
        tidy(F.coalesce(area, none)).alias("area_under_curve"),
        tidy(F.coalesce(slope, none)).alias("mean_slope"),
        tidy(F.coalesce(F.get(ys, F.lit(0)), none)).alias("start_value"),
        tidy(F.coalesce(F.get(ys, n - 1), none)).alias("end_value"),
        tidy(F.coalesce(peak - F.array_min(ys), none)).alias("value_range"),
        tidy(F.coalesce(deviation, none)).alias("std_dev"),
    )


def threshold_features(table: DataFrame, keys: list[str], x: str, y: str, level: float) -> DataFrame:
    """The first x at which the curve reaches a level (infinity if never), and the share of points that do."""
    over = F.transform(y, lambda v: v >= level)
    first = F.array_position(over, F.lit(True)).cast("int")
    return table.select(*keys, F.coalesce(F.when(first > 0, F.element_at(x, first)), F.lit(float("inf"))).cast("double").alias("first_x"), tidy(F.coalesce(_share(over), F.lit(0.0))).alias("share_over"))


def signal_checks(table: DataFrame, keys: list[str], y: str, ceiling: float, sigmas: float = 4.0) -> DataFrame:
    """Spikes against the four neighbours of each point, adjacent decreases, negative and saturated points."""
    ys = F.col(y)
    n = F.size(ys)

    def spike(v: Column, i: Column) -> Column:
        low = F.greatest(i - 2, F.lit(0))
        left, right = F.slice(ys, low + 1, i - low), F.slice(ys, i + 2, F.lit(2))
        around = F.concat(left, right)
        mean = F.try_divide(_sum(around), F.size(around))
        width = F.sqrt(F.greatest(F.lit(0.0), F.try_divide(_sum(F.transform(around, lambda a: a * a)), F.size(around)) - mean * mean))
        return F.when(width > 1e-9, F.abs(v - mean) > sigmas * width).otherwise(F.abs(v - mean) > 1e-9)

    spikes = F.when(n >= 3, F.size(F.filter(F.transform(ys, spike), lambda s: s))).otherwise(0)
    falls = _share(_pairs(ys, lambda a, b: b < a))
    negative = _share(F.transform(ys, lambda v: v < 0))
    full = F.size(F.filter(ys, lambda v: v >= 0.99 * ceiling))
    return table.select(*keys, spikes.alias("n_spikes"), (F.coalesce(falls, F.lit(0.0)) > 0.2).alias("inconsistent"), (F.coalesce(negative, F.lit(0.0)) > 0.05).alias("negative"), full.alias("n_saturated"))


def one_hot(table: DataFrame, column: str, categories: list[str]) -> DataFrame:
    """The place of a value among ``categories`` as an array of zeros and a one; unknown values are all zeros."""
    return table.withColumn(f"{column}_onehot", F.array(*(F.coalesce((F.col(column) == c).cast("int"), F.lit(0)) for c in categories)))


def ordinal(table: DataFrame, column: str, categories: list[str]) -> DataFrame:
    """A value's place among ``categories``, from 0 to 1; null if unknown."""
    at = F.array_position(F.array(*map(F.lit, categories)), F.col(column))
    return table.withColumn(f"{column}_ordinal", F.when(at > 0, (at - 1) / max(1, len(categories) - 1)))

"""Ordered analytics within a campaign: running bests, smoothing, trends, seasons and regime changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import safe_corr, tidy
from ..sources.tables import keep


def _line(*by: str) -> Window:
    return Window.partitionBy(*(by or ("campaign_id",))).orderBy("iteration")


def best_so_far(obs: DataFrame, maximize: bool = True) -> DataFrame:
    run = _line().rowsBetween(Window.unboundedPreceding, 0)
    value = F.when(~F.col("is_failure"), F.col("kpi"))
    return obs.select("campaign_id", "iteration", (F.max if maximize else F.min)(value).over(run).alias("best"))


def moving_average(obs: DataFrame, window: int) -> DataFrame:
    """Trailing mean; shorter frames at the start."""
    return obs.select("campaign_id", "iteration", tidy(F.avg("kpi").over(_line().rowsBetween(1 - window, 0)), 4).alias("smooth"))


def cumulative_cost(obs: DataFrame, cost: str = "p_quantity") -> DataFrame:
    """Running cost, and regret to the campaign's best per unit of it."""
    run = _line().rowsBetween(Window.unboundedPreceding, 0)
    spent = F.sum(cost).over(run)
    gap = F.max("kpi").over(Window.partitionBy("campaign_id")) - F.max("kpi").over(run)
    return obs.select("campaign_id", "iteration", tidy(spent).alias("spent"), tidy(F.when(spent > 0, gap / spent).otherwise(0.0)).alias("regret_per_cost"))


def time_weights(obs: DataFrame, rate: float = 0.01, span: int = 50) -> DataFrame:
    """Recency weights of each row: exponential, sliding and linear, the latest row having 1."""
    every = Window.partitionBy("campaign_id")
    age = F.max("iteration").over(every) - F.col("iteration")
    n = F.count("*").over(every)
    return obs.select("campaign_id", "iteration", tidy(F.exp(-rate * age)).alias("exponential"), (age < span).cast("double").alias("sliding"), tidy((n - age) / n).alias("linear"))


def autocorrelation(obs: DataFrame, lags: range) -> DataFrame:
    """Correlation of the objective with itself at each lag, about the whole series' mean."""
    every = Window.partitionBy("campaign_id")
    rows = obs.select("campaign_id", "iteration", (F.col("kpi") - F.avg("kpi").over(every)).alias("d"))
    rows = rows.select("campaign_id", "d", *((F.col("d") * F.lag("d", k).over(_line())).alias(f"at_{k}") for k in lags))
    later = F.array(*(F.struct(F.lit(k).alias("lag"), F.col(f"at_{k}").alias("product")) for k in lags))
    parts = rows.select("campaign_id", "d", F.inline(later))
    return parts.groupBy("campaign_id", "lag").agg(F.coalesce(F.when(F.sum(F.col("d") * F.col("d")) > 0, F.sum("product") / F.sum(F.col("d") * F.col("d"))), F.lit(0.0)).alias("r"))


def season(obs: DataFrame, lags: range, least: float = 0.5) -> DataFrame:
    """The strongest lag of each campaign, the first on ties, and whether it exceeds ``least``."""
    best = autocorrelation(obs, lags).groupBy("campaign_id").agg(F.max_by(F.struct("lag", "r"), F.struct(tidy(F.col("r")), -F.col("lag"))).alias("top"))
    return best.select("campaign_id", F.col("top.lag").alias("period"), tidy(F.col("top.r")).alias("strength"), (F.col("top.r") > least).alias("seasonal"))


def regime_change(obs: DataFrame, least: int = 5) -> DataFrame:
    """The split of each campaign at which the means before and after differ most, in pooled deviations."""
    run, every = _line().rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("campaign_id")
    rows = obs.select("campaign_id", "iteration", F.count("kpi").over(run).alias("n1"), F.sum("kpi").over(run).alias("s1"), F.count("kpi").over(every).alias("n"), F.sum("kpi").over(every).alias("s"), F.stddev_pop("kpi").over(every).alias("sd"))
    rows = rows.where((F.col("n1") >= least) & (F.col("n") - F.col("n1") >= least) & (F.col("sd") > 0))
    gap = F.abs(F.col("s1") / F.col("n1") - (F.col("s") - F.col("s1")) / (F.col("n") - F.col("n1"))) / F.col("sd")
    best = rows.withColumn("gap", tidy(gap)).groupBy("campaign_id").agg(F.max_by(F.struct("iteration", "gap"), F.struct(F.col("gap"), -F.col("iteration"))).alias("top"))
    return best.select("campaign_id", F.col("top.iteration").alias("split_at"), F.col("top.gap").alias("gap"))


def phase_transitions(obs: DataFrame, phase: str) -> DataFrame:
    """Rows whose phase differs from the row before."""
    before = F.lag(phase).over(_line())
    rows = obs.select("campaign_id", "iteration", before.alias("from_phase"), F.col(phase).alias("to_phase"))
    return rows.where(F.col("from_phase").isNotNull() & (F.col("from_phase") != F.col("to_phase")))


def trends(obs: DataFrame) -> DataFrame:
    """Means, deviations and running-best gain of each campaign's first and second half."""
    every = Window.partitionBy("campaign_id")
    run = _line().rowsBetween(Window.unboundedPreceding, 0)
    rows = obs.select("campaign_id", "kpi", (F.col("iteration") * 2 >= F.count("*").over(every)).alias("late"), F.max("kpi").over(run).alias("best"))
    half = lambda f, late: f(F.when(F.col("late") == late, F.col("kpi")))
    return rows.groupBy("campaign_id").agg(
        tidy(half(F.avg, False), 8).alias("early_mean"),
        tidy(half(F.avg, True), 8).alias("late_mean"),
        tidy(half(F.stddev_samp, False), 8).alias("early_sd"),
        tidy(half(F.stddev_samp, True), 8).alias("late_sd"),
        tidy(F.max("best") - F.max(F.when(~F.col("late"), F.col("best"))), 8).alias("late_gain"),
    )


def drift_report(obs: DataFrame, params: list[str], window: int = 10) -> DataFrame:
    """The last ``window`` rows of each campaign against the ones before: mean shift, and correlation change by parameter."""
    back = F.row_number().over(Window.partitionBy("campaign_id").orderBy(F.desc("iteration")))
    rows = obs.withColumn("back", back).where(F.col("back") <= 2 * window).withColumn("fresh", F.col("back") <= window)
    wide = rows.unpivot(["campaign_id", "kpi", "fresh"], params, "name", "x")
    new, old = F.col("fresh"), ~F.col("fresh")
    shift = F.avg(F.when(new, F.col("x"))) - F.avg(F.when(old, F.col("x")))
    sd = F.stddev_pop("x")
    return wide.groupBy("campaign_id", "name").agg(
        tidy(safe_corr(F.col("x"), F.col("kpi"), old), 5).alias("corr_before"),
        tidy(safe_corr(F.col("x"), F.col("kpi"), new), 5).alias("corr_after"),
        tidy(F.when(sd > 0, shift / sd).otherwise(0.0), 5).alias("mean_shift"),
    )


def kpi_shift(obs: DataFrame, window: int = 10) -> DataFrame:
    """Welch's statistic between the last ``window`` objectives and those before, over 4 and at most 1."""
    back = F.row_number().over(Window.partitionBy("campaign_id").orderBy(F.desc("iteration")))
    rows = obs.withColumn("back", back).where(F.col("back") <= 2 * window)
    part = lambda f, new: f(F.when((F.col("back") <= window) == new, F.col("kpi")))
    gap = F.abs(part(F.avg, True) - part(F.avg, False))
    error = F.sqrt(part(F.var_samp, True) / part(F.count, True) + part(F.var_samp, False) / part(F.count, False))
    return rows.groupBy("campaign_id").agg(tidy(F.coalesce(F.when(error > 0, F.least(F.lit(1.0), gap / error / 4)), F.lit(0.0)), 5).alias("shift"))


def numbered(table: DataFrame, *order: Column, name: str = "place") -> DataFrame:
    """``table`` with each row's place, from 1, in an order of all its rows; rows alike in the order are numbered in any way.

    Rows are dealt out by ranges of the order and written, and each range counts on from those before it, so no task sorts the whole table.
    """
    ranges = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keep(table.repartitionByRange(ranges, *order).withColumn("range_", F.spark_partition_id()), "numbered")
    sizes = dealt.groupBy("range_").agg(F.count("*").alias("n_"))
    # One row for each range, whatever the table's size.
    before = sizes.select("range_", F.coalesce(F.sum("n_").over(Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before_"))
    place = F.col("before_") + F.row_number().over(Window.partitionBy("range_").orderBy(*order))
    return dealt.join(F.broadcast(before), "range_").withColumn(name, place).drop("range_", "before_")

"""Confounders among the metadata, drift by dimension, data quality, and imputation from near trials."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import safe_corr, tidy
from ..model import Spec
from . import near
from .store import long_form


def confounders(obs: DataFrame, names: list[str], threshold: float = 0.3) -> DataFrame:
    """Metadata columns whose numbers correlate with the objective beyond ``threshold``, three pairs at least."""
    rows = long_form(obs.select("campaign_id", "kpi", *(F.expr(f"try_cast({n} AS double)").alias(n) for n in names)), names).where("x IS NOT NULL AND kpi IS NOT NULL")
    found = rows.groupBy("campaign_id", "name").agg(F.count("*").alias("n"), F.abs(safe_corr(F.col("x"), F.col("kpi"))).alias("r"))
    return found.where((F.col("n") >= 3) & (F.col("r") > threshold)).select("campaign_id", "name", "n", tidy(F.col("r")).alias("max_abs_correlation"))


def covariate(obs: DataFrame, name: str) -> DataFrame:
    """A confounder made a parameter: its bounds, never empty, and how many trials carry it."""
    found = obs.groupBy("campaign_id").agg(F.coalesce(F.min(name), F.lit(0.0)).alias("lower"), F.coalesce(F.max(name), F.lit(1.0)).alias("top"), F.count(name).alias("n_affected"))
    return found.select("campaign_id", tidy(F.col("lower")).alias("lower"), tidy(F.when(F.col("lower") == F.col("top"), F.col("lower") + 1).otherwise(F.col("top"))).alias("upper"), "n_affected")


def _outside(name: str, low: float | None, high: float | None) -> Column:
    tests = ([F.col(name) < low] if low is not None else []) + ([F.col(name) > high] if high is not None else [])
    out = F.lit(False)
    for test in tests:
        out = out | test
    return F.coalesce(out, F.lit(False))


def flag_high_risk(obs: DataFrame, name: str, low: float | None, high: float | None) -> DataFrame:
    """Every trial with weight 1, or 0.5 where its confounder is outside the limits (present at all, if there are none)."""
    flagged = F.col(name).isNotNull() if low is None and high is None else _outside(name, low, high)
    return obs.withColumn("flagged", flagged).withColumn("weight", F.when(F.col("flagged"), 0.5).otherwise(1.0))


def exclude(obs: DataFrame, name: str, low: float | None, high: float | None) -> DataFrame:
    """The trials whose confounder is within the limits or missing."""
    return obs.where(~_outside(name, low, high))


def kpi_stats(obs: DataFrame) -> DataFrame:
    """Count, mean, population deviation and bounds of each campaign's objective."""
    return obs.groupBy("campaign_id").agg(F.count("kpi").alias("n"), tidy(F.avg("kpi"), 4).alias("mean"), tidy(F.stddev_pop("kpi"), 4).alias("std"), tidy(F.min("kpi")).alias("least"), tidy(F.max("kpi")).alias("most"))


def instrument_drift(obs: DataFrame, least_r2: float = 0.3) -> DataFrame:
    """The trend of the successes' objective over time, and the trend that is left in the residuals of that fit."""
    ok = obs.where(~F.col("is_failure") & F.col("kpi").isNotNull())
    fit = ok.groupBy("campaign_id").agg(F.count("*").alias("n"), F.regr_slope("kpi", "iteration").alias("slope"), F.regr_intercept("kpi", "iteration").alias("base")).where("n >= 3")
    rest = ok.join(fit, "campaign_id").withColumn("rest", F.col("kpi") - F.coalesce("slope", F.lit(0.0)) * F.col("iteration") - F.coalesce("base", F.col("kpi")))
    left = rest.groupBy("campaign_id").agg(F.first("slope").alias("trend"), F.regr_slope("rest", "iteration").alias("slope"), F.regr_r2("rest", "iteration").alias("r2"))
    slope = F.coalesce("slope", F.lit(0.0))
    direction = F.when(slope > 0.001, "increasing").when(slope < -0.001, "decreasing").otherwise("stable")
    return left.select("campaign_id", tidy(F.coalesce("trend", F.lit(0.0)), 4).alias("trend"), tidy(slope, 4).alias("drift_slope"), (F.coalesce("r2", F.lit(0.0)) > least_r2).alias("detected"), direction.alias("direction"))


def quality_score(noise: DataFrame, batches: DataFrame, drift: DataFrame) -> DataFrame:
    """One score in [0, 1] per campaign from noise (total_noise, ratio), batch effects (detected, eta_squared) and drift (detected, r_squared)."""
    rows = noise.join(batches.select("campaign_id", F.col("detected").alias("batch"), "eta_squared"), "campaign_id", "left").join(drift.select("campaign_id", F.col("detected").alias("drift"), "r_squared"), "campaign_id", "left")
    cost = lambda test, points: F.when(F.coalesce(test, F.lit(False)), points).otherwise(0.0)
    score = 1 - cost(F.col("total_noise") > 0.5, F.lit(0.2)) - cost(F.col("ratio") > 0.7, F.lit(0.1)) - cost(F.col("batch"), 0.2 * F.col("eta_squared")) - cost(F.col("drift"), 0.2 * F.col("r_squared"))
    return rows.select("campaign_id", tidy(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 4).alias("quality"))


def _recent(obs: DataFrame, reference: int, test: int) -> DataFrame:
    """The last reference + test successes of campaigns that have them; ``fresh`` marks the last ``test``."""
    line = Window.partitionBy("campaign_id").orderBy(F.desc("iteration"))
    rows = obs.where(~F.col("is_failure")).withColumn("back", F.row_number().over(line)).where(F.col("back") <= reference + test)
    n = F.count("*").over(Window.partitionBy("campaign_id"))
    return rows.withColumn("n_recent", n).where(F.col("n_recent") == reference + test).withColumn("fresh", F.col("back") <= test)


def attribute_drift(obs: DataFrame, params: list[str], reference: int = 10, test: int = 10) -> DataFrame:
    """How much each parameter explains a drift: the shift of its correlation with the objective, and of its own mean."""
    rows = long_form(_recent(obs, reference, test).select("campaign_id", "kpi", "fresh", *params), params)
    part = lambda f, fresh: f(F.when(F.col("fresh") == fresh, F.col("x")))
    shift = F.abs(safe_corr(F.col("x"), F.col("kpi"), F.col("fresh")) - safe_corr(F.col("x"), F.col("kpi"), ~F.col("fresh")))
    moved = F.abs(part(F.avg, True) - part(F.avg, False)) / F.greatest(part(F.stddev_samp, False), F.lit(1e-12))
    found = rows.groupBy("campaign_id", "name").agg(shift.alias("c"), moved.alias("m"))
    score = 0.6 * F.least(F.col("c"), F.lit(1.0)) + 0.4 * F.least(F.col("m") / 3, F.lit(1.0))
    return found.select("campaign_id", "name", tidy(F.col("c"), 5).alias("correlation_shift"), tidy(F.col("m"), 5).alias("mean_shift"), tidy(score, 4).alias("score"))


def residual_shift(obs: DataFrame, param: str, reference: int = 10, test: int = 10) -> DataFrame:
    """A line fitted to the reference window and the residuals it leaves in the test window, against the spread of both."""
    rows = _recent(obs, reference, test)
    old = lambda c: F.when(~F.col("fresh"), F.col(c))
    fit = rows.groupBy("campaign_id").agg(F.regr_slope(old("kpi"), old(param)).alias("slope"), F.avg(old("kpi")).alias("my"), F.avg(old(param)).alias("mx"), F.stddev_samp(old("kpi")).alias("spread"))
    rest = rows.where("fresh").join(fit, "campaign_id").withColumn("rest", F.col("kpi") - F.col("my") - F.coalesce("slope", F.lit(0.0)) * (F.col(param) - F.col("mx")))
    out = rest.groupBy("campaign_id").agg(F.avg("rest").alias("mean"), F.stddev_samp("rest").alias("std"), F.first("spread").alias("spread"))
    stat = F.abs("mean") / F.greatest("spread", "std", F.lit(1e-12))
    return out.select("campaign_id", tidy(F.col("mean"), 3).alias("residual_mean"), tidy(F.col("std"), 3).alias("residual_std"), tidy(F.least(stat / 3, F.lit(1.0)), 5).alias("score"))


def drift_window(scores: DataFrame, counts: DataFrame, least: float = 0.3, test: int = 10) -> DataFrame:
    """How many of the latest successes to model: all without drift, fewer the more drift there is."""
    rows = counts.join(scores.select("campaign_id", "score"), "campaign_id", "left")
    keep = F.floor(F.col("n") * F.greatest(F.lit(0.25), 1 - 0.75 * F.col("score")))
    window = F.when(F.coalesce("score", F.lit(0.0)) < least, F.col("n")).otherwise(F.least(F.col("n"), F.greatest(F.lit(test), keep)))
    return rows.select("campaign_id", "n", window.cast("long").alias("n_kept"))


def rolling_scores(obs: DataFrame, segment: int = 10) -> DataFrame:
    """Each half-overlapping later segment of successes against the first segment: pooled t over 4, at most 1."""
    step = max(segment // 2, 2)
    line = Window.partitionBy("campaign_id")
    ok = obs.where(~F.col("is_failure")).withColumn("at", F.row_number().over(line.orderBy("iteration")) - 1).withColumn("n", F.count("*").over(line)).where(F.col("n") >= 2 * segment)
    base = ok.where(F.col("at") < segment).groupBy("campaign_id").agg(F.avg("kpi").alias("m0"), F.stddev_samp("kpi").alias("s0"))
    last = F.floor((F.col("at") - segment) / step)
    first = F.greatest(F.lit(0), F.floor((F.col("at") - 2 * segment) / step) + 1)
    rows = ok.where(F.col("at") >= segment).select("campaign_id", "kpi", "n", F.explode(F.sequence(first.cast("long"), last.cast("long"))).alias("k")).where(F.col("k") * step + 2 * segment <= F.col("n"))
    parts = rows.groupBy("campaign_id", "k").agg(F.avg("kpi").alias("m"), F.stddev_samp("kpi").alias("s")).join(base, "campaign_id")
    pooled = F.sqrt((F.col("s0") ** 2 + F.col("s") ** 2) / 2)
    score = F.when(pooled > 0, F.least(F.abs(F.col("m0") - F.col("m")) / pooled / 4, F.lit(1.0))).otherwise(0.0)
    return parts.select("campaign_id", F.col("k").cast("long").alias("segment"), tidy(score, 5).alias("score"))


def distance(a: str, b: str, specs: tuple[Spec, ...]) -> Column:
    """Euclidean distance of the parameters of two trials, each scaled to its bounds."""
    return F.sqrt(sum((((F.col(f"{a}.{s.name}") - F.col(f"{b}.{s.name}")) / (s.upper - s.lower)) ** 2 for s in specs), F.lit(0.0)))


def impute_near(obs: DataFrame, specs: tuple[Spec, ...], k: int = 5, block: int = near.BLOCK) -> DataFrame:
    """Failures with the mean objective of their ``k`` nearest successes in the campaign, ties to the earlier trial; 0 without a success.

    A success without an objective says nothing.  Failures meet successes in blocks of about ``block`` trials (``near.nearest``).
    """
    widths = [s.upper - s.lower for s in specs]

    def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.sqrt(sum((((a[:, i, None] - b[None, :, i]) / w) ** 2 for i, w in enumerate(widths)), np.zeros((len(a), len(b)))))

    told = near.nearest(obs.where("is_failure"), obs.where("NOT is_failure AND kpi IS NOT NULL"), "iteration", "iteration", [F.col(s.name) for s in specs], F.col("kpi"), apart, k, block)
    mean = F.aggregate("near.y", F.lit(0.0), lambda a, y: a + y) / F.when(F.size("near") > 0, F.size("near"))
    return told.select("campaign_id", "iteration", F.size("near").alias("n_near"), tidy(F.coalesce(mean, F.lit(0.0)), 3).alias("kpi"))


def sensitivity(obs: DataFrame, specs: tuple[Spec, ...], near: int = 5, maximize: bool = True) -> DataFrame:
    """Each parameter's score: half its correlation with the objective, half the gradient around the best trial."""
    ok = obs.where(~F.col("is_failure"))
    best = F.max_by if maximize else F.min_by
    top = ok.groupBy("campaign_id").agg(best(F.struct("iteration", "kpi", *(s.name for s in specs)), F.struct("kpi", -F.col("iteration")) if maximize else F.struct("kpi", "iteration")).alias("t"), (F.max("kpi") - F.min("kpi")).alias("span"))
    rows = ok.join(top, "campaign_id").where("iteration != t.iteration").withColumn("o", F.struct("kpi", *(s.name for s in specs)))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("campaign_id").orderBy(distance("o", "t", specs), "iteration"))).where(F.col("rank") <= near)
    slopes = rows.select("campaign_id", "span", F.inline(F.array(*(F.struct(F.lit(s.name).alias("name"), F.lit(s.upper - s.lower).alias("wide"), (F.col(f"o.{s.name}") - F.col(f"t.{s.name}")).alias("dx"), (F.col("o.kpi") - F.col("t.kpi")).alias("dy")) for s in specs))))
    steep = slopes.where("abs(dx) >= 1e-15").groupBy("campaign_id", "name").agg(F.try_divide(F.avg(F.abs(F.col("dy") / F.col("dx"))) * F.first("wide"), F.first("span")).alias("gradient"))
    linear = long_form(ok.select("campaign_id", "kpi", *(s.name for s in specs)), [s.name for s in specs]).groupBy("campaign_id", "name").agg(safe_corr(F.col("x"), F.col("kpi")).alias("r"))
    both = linear.join(steep, ["campaign_id", "name"], "left")
    local = F.coalesce("gradient", F.lit(0.0))
    score = 0.5 * F.abs("r") + 0.5 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), local))
    return both.select("campaign_id", "name", tidy(F.col("r"), 5).alias("correlation"), tidy(local, 4).alias("local_gradient"), tidy(score, 5).alias("score"))


def steps(obs: DataFrame, specs: tuple[Spec, ...], importance: DataFrame) -> DataFrame:
    """The direction in which each parameter moves the objective, and a step: a smaller share of its range the more important it is."""
    rows = long_form(obs.select("campaign_id", "kpi", *(s.name for s in specs)), [s.name for s in specs]).groupBy("campaign_id", "name").agg(tidy(F.covar_pop("x", "kpi")).alias("c"))
    wide = F.lit(0.0)
    for s in specs:
        wide = F.when(F.col("name") == s.name, F.lit(s.upper - s.lower)).otherwise(wide)
    weight = F.coalesce("importance", F.lit(0.0))
    size = wide * F.when(weight > 0.5, 0.05).when(weight > 0.2, 0.1).otherwise(0.2)
    return rows.join(importance, ["campaign_id", "name"], "left").select("campaign_id", "name", F.signum("c").alias("direction"), tidy(size).alias("step"))

"""What drives a campaign: correlations, interactions, regions, failure patterns, importance and data quality.

Every per-parameter question is one aggregation over the long form, never one job per parameter.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import safe_corr, tidy
from ..model import Spec


def _long(obs: DataFrame, params: list[str]) -> DataFrame:
    return obs.unpivot(["campaign_id", "iteration", "kpi", "is_failure"], params, "name", "x")


def correlations(obs: DataFrame, params: list[str], least: int = 5) -> DataFrame:
    """Pearson correlation of each parameter with the objective over successes."""
    rows = _long(obs.where(~F.col("is_failure")), params)
    return rows.groupBy("campaign_id", "name").agg(F.count("x").alias("n"), tidy(safe_corr(F.col("x"), F.col("kpi")), 5).alias("r")).where(F.col("n") >= least)


def interactions(obs: DataFrame, params: list[str], least: int = 10) -> DataFrame:
    """Correlation of each product of two parameters with the objective."""
    pairs = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), (F.col(a) * F.col(b)).alias("x")) for a, b in combinations(params, 2)))
    rows = obs.where(~F.col("is_failure")).select("campaign_id", "kpi", F.inline(pairs))
    return rows.groupBy("campaign_id", "a", "b").agg(F.count("x").alias("n"), tidy(safe_corr(F.col("x"), F.col("kpi")), 5).alias("r")).where(F.col("n") >= least)


def optimal_regions(obs: DataFrame, params: list[str], share: float = 0.2, least: int = 3) -> DataFrame:
    """The range of each parameter among a campaign's best rows, and mean objectives inside and outside it."""
    ok = obs.where(~F.col("is_failure"))
    place = F.row_number().over(Window.partitionBy("campaign_id").orderBy(F.desc("kpi"), "iteration"))
    k = F.greatest(F.floor(F.count("*").over(Window.partitionBy("campaign_id")) * share), F.lit(least))
    rows = _long(ok.withColumn("top", place <= k).withColumn("is_failure", F.col("top")), params)
    same = Window.partitionBy("campaign_id", "name")
    low, high = F.min(F.when(F.col("is_failure"), F.col("x"))).over(same), F.max(F.when(F.col("is_failure"), F.col("x"))).over(same)
    rows = rows.withColumn("low", low).withColumn("high", high).withColumn("inside", F.col("x").between(F.col("low"), F.col("high")))
    mean = lambda inside: tidy(F.avg(F.when(F.col("inside") == inside, F.col("kpi"))), 4)
    return rows.groupBy("campaign_id", "name").agg(F.first("low").alias("low"), F.first("high").alias("high"), mean(True).alias("mean_inside"), mean(False).alias("mean_outside"))


def failure_patterns(obs: DataFrame, params: list[str], factor: float = 1.5) -> DataFrame:
    """The middle half of each parameter's failing values, the failure rate in it, and whether that is high."""
    rows = _long(obs, params)
    bad = rows.where("is_failure")
    place = F.row_number().over(Window.partitionBy("campaign_id", "name").orderBy("x")) - 1
    n = F.count("*").over(Window.partitionBy("campaign_id", "name"))
    marked = bad.select("campaign_id", "name", "x", place.alias("at"), n.alias("n"))
    low = F.max(F.when(F.col("at") == F.floor(F.col("n") / 4), F.col("x")))
    high = F.max(F.when(F.col("at") == F.least(F.col("n") - 1, F.floor(F.col("n") * 3 / 4)), F.col("x")))
    zones = marked.groupBy("campaign_id", "name").agg(low.alias("low"), high.alias("high"))
    inside = F.col("x").between(F.col("low"), F.col("high"))
    rate = rows.join(zones, ["campaign_id", "name"]).groupBy("campaign_id", "name").agg(F.first("low").alias("low"), F.first("high").alias("high"), F.avg(F.when(inside, F.col("is_failure").cast("double"))).alias("zone_rate"), F.avg(F.col("is_failure").cast("double")).alias("rate"))
    return rate.select("campaign_id", "name", "low", "high", tidy(F.col("zone_rate")).alias("zone_rate"), tidy(F.col("rate")).alias("rate"), (F.col("zone_rate") > factor * F.col("rate")).alias("risky"))


def failure_density(obs: DataFrame, specs: tuple[Spec, ...], bins: int = 10) -> DataFrame:
    """Failure rate by equal bins of each parameter's bounds; values beyond them count in the end bins."""
    bucket = F.lit(None).cast("long")
    for s in specs:
        at = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((F.col("x") - s.lower) / (s.upper - s.lower) * bins)))
        bucket = F.when(F.col("name") == s.name, at).otherwise(bucket)
    rows = _long(obs, [s.name for s in specs]).where("x IS NOT NULL").withColumn("bin", bucket)
    return rows.groupBy("campaign_id", "name", "bin").agg(F.count("*").alias("n"), tidy(F.avg(F.col("is_failure").cast("double"))).alias("rate"))


def safe_bounds(obs: DataFrame, specs: tuple[Spec, ...], margin: float = 0.05) -> DataFrame:
    """The box of successes with a margin, inside the parameter's bounds."""
    rows = _long(obs.where(~F.col("is_failure")), [s.name for s in specs])
    own = rows.groupBy("campaign_id", "name").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    low = high = F.lit(None).cast("double")
    gap = (F.col("hi") - F.col("lo")) * margin
    for s in specs:
        low = F.when(F.col("name") == s.name, F.greatest(F.lit(s.lower), F.col("lo") - gap)).otherwise(low)
        high = F.when(F.col("name") == s.name, F.least(F.lit(s.upper), F.col("hi") + gap)).otherwise(high)
    return own.select("campaign_id", "name", tidy(low).alias("low"), tidy(high).alias("high"))


def danger_zones(obs: DataFrame, params: list[str], least: float = 0.4) -> DataFrame:
    """Halves of each parameter, split at its sorted middle, in which at least ``least`` of the rows fail."""
    order = Window.partitionBy("campaign_id", "name")
    rows = _long(obs, params).withColumn("at", F.row_number().over(order.orderBy("x", "iteration")) - 1).withColumn("n", F.count("*").over(order))
    half = F.when(F.col("at") < F.floor(F.col("n") / 2), "low").otherwise("high")
    zones = rows.withColumn("half", half).groupBy("campaign_id", "name", "half").agg(F.min("x").alias("low"), F.max("x").alias("high"), tidy(F.avg(F.col("is_failure").cast("double"))).alias("rate"))
    return zones.where(F.col("rate") >= least)


def importance(obs: DataFrame, params: list[str], share: float = 0.2) -> DataFrame:
    """Three views of each parameter's weight: correlation, variance contraction in the best rows, best against worst."""
    ok = obs.where(~F.col("is_failure"))
    every = Window.partitionBy("campaign_id")
    k = F.greatest(F.floor(F.count("*").over(every) * share), F.lit(2))
    place = F.row_number().over(every.orderBy(F.desc("kpi"), "iteration"))
    back = F.row_number().over(every.orderBy(F.asc("kpi"), F.desc("iteration")))
    rows = ok.withColumn("k", k).withColumn("end", F.when(place <= F.col("k"), "top").when(back <= F.col("k"), "bottom"))
    wide = rows.unpivot(["campaign_id", "kpi", "end"], params, "name", "x")
    top, bottom = F.when(F.col("end") == "top", F.col("x")), F.when(F.col("end") == "bottom", F.col("x"))
    stats = wide.groupBy("campaign_id", "name").agg(
        F.abs(safe_corr(F.col("x"), F.col("kpi"))).alias("correlation"),
        F.var_samp("x").alias("v"),
        F.var_samp(top).alias("vt"),
        F.var_samp(bottom).alias("vb"),
        F.avg(top).alias("mt"),
        F.avg(bottom).alias("mb"),
        F.count(top).alias("nt"),
        F.count(bottom).alias("nb"),
    )
    contraction = F.when(F.col("v") > 0, F.greatest(F.lit(0.0), 1 - F.col("vt") / F.col("v"))).otherwise(0.0)
    error = F.col("vt") / F.col("nt") + F.col("vb") / F.col("nb")
    contrast = F.when(error > 0, (F.col("mt") - F.col("mb")) ** 2 / error).otherwise(0.0)
    return stats.select("campaign_id", "name", tidy(F.col("correlation"), 5).alias("correlation"), tidy(contraction, 5).alias("contraction"), tidy(contrast, 4).alias("contrast"))


def noise_decomposition(obs: DataFrame, spec: Spec, bins: int = 5) -> DataFrame:
    """Deviation within and between equal bins of one parameter, and in all."""
    at = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((F.col(spec.name) - spec.lower) / (spec.upper - spec.lower) * bins)))
    ok = obs.where(~F.col("is_failure")).withColumn("bin", at)
    inner = ok.groupBy("campaign_id", "bin").agg(F.count("kpi").alias("n"), F.avg("kpi").alias("m"), F.var_pop("kpi").alias("v"))
    parts = inner.groupBy("campaign_id").agg(F.avg(F.when(F.col("n") >= 2, F.col("v"))).alias("within"), F.var_pop("m").alias("between"))
    whole = ok.groupBy("campaign_id").agg(F.var_pop("kpi").alias("total"))
    return parts.join(whole, "campaign_id").select("campaign_id", tidy(F.sqrt("within"), 4).alias("within_sd"), tidy(F.sqrt("between"), 4).alias("between_sd"), tidy(F.sqrt("total"), 4).alias("total_sd"))


def batch_effects(obs: DataFrame, size: int = 10, least_f: float = 3.0) -> DataFrame:
    """One-way analysis of variance over batches of ``size`` rows; a last batch of one joins the one before."""
    every = Window.partitionBy("campaign_id")
    n = F.count("*").over(every)
    batch = F.floor(F.col("iteration") / size)
    batch = F.when((n % size == 1) & (F.col("iteration") == n - 1) & (batch > 0), batch - 1).otherwise(batch)
    groups = obs.withColumn("batch", batch).groupBy("campaign_id", "batch").agg(F.count("*").alias("n"), F.avg("kpi").alias("m"), F.var_pop("kpi").alias("v"))
    whole = F.sum(F.col("n") * F.col("m")).over(every) / F.sum("n").over(every)
    sums = groups.withColumn("mean", whole).groupBy("campaign_id").agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("m") - F.col("mean")) ** 2).alias("ssb"), F.sum(F.col("n") * F.col("v")).alias("ssw"))
    f = F.when((F.col("k") > 1) & (F.col("n") > F.col("k")) & (F.col("ssw") > 0), (F.col("ssb") / (F.col("k") - 1)) / (F.col("ssw") / (F.col("n") - F.col("k")))).otherwise(0.0)
    eta = F.when(F.col("ssb") + F.col("ssw") > 0, F.col("ssb") / (F.col("ssb") + F.col("ssw"))).otherwise(0.0)
    return sums.select("campaign_id", F.col("k").alias("n_batches"), tidy(f, 5).alias("f_statistic"), tidy(eta, 5).alias("eta_squared"), (f > least_f).alias("detected"))


def heteroscedasticity(obs: DataFrame, specs: tuple[Spec, ...], bins: int = 5, ratio: float = 3.0) -> DataFrame:
    """The largest against the smallest coefficient of variation over bins of each parameter."""
    bucket = F.lit(None).cast("long")
    for s in specs:
        at = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((F.col("x") - s.lower) / (s.upper - s.lower) * bins)))
        bucket = F.when(F.col("name") == s.name, at).otherwise(bucket)
    rows = _long(obs.where(~F.col("is_failure")), [s.name for s in specs]).withColumn("bin", bucket)
    cells = rows.groupBy("campaign_id", "name", "bin").agg(F.count("kpi").alias("n"), F.avg("kpi").alias("m"), F.stddev_pop("kpi").alias("s")).where("n >= 2 AND m <> 0")
    cv = F.col("s") / F.abs("m")
    out = cells.groupBy("campaign_id", "name").agg(F.max(cv).alias("hi"), F.min(cv).alias("lo"))
    r = F.when(F.col("lo") > 0, F.col("hi") / F.col("lo")).otherwise(0.0)
    return out.select("campaign_id", "name", tidy(r, 5).alias("cv_ratio"), (r > ratio).alias("uneven"))


def impute(obs: DataFrame) -> DataFrame:
    """Failures' objectives filled from their campaign's successes: by mean, median and worst (least) value."""
    ok = F.when(~F.col("is_failure"), F.col("kpi"))
    fills = obs.groupBy("campaign_id").agg(F.avg(ok).alias("mean"), F.percentile(ok, F.lit(0.5)).alias("median"), F.coalesce(F.min(ok), F.lit(0.0)).alias("worst"))
    rows = obs.join(fills, "campaign_id")
    fill = lambda name: tidy(F.when(F.col("is_failure"), F.col(name)).otherwise(F.col("kpi")), 4).alias(f"by_{name}")
    return rows.select("campaign_id", "iteration", fill("mean"), fill("median"), fill("worst"))


def confounder_normalize(obs: DataFrame, confounder: str) -> DataFrame:
    """The objective with its regression on a confounder taken out, the mean kept."""
    fit = obs.groupBy("campaign_id").agg(F.regr_slope("kpi", confounder).alias("slope"), F.avg(confounder).alias("mx"))
    clean = F.col("kpi") - F.coalesce("slope", F.lit(0.0)) * (F.col(confounder) - F.col("mx"))
    return obs.join(fit, "campaign_id").select("campaign_id", "iteration", tidy(clean, 4).alias("kpi"))


def treatment_effect(obs: DataFrame, treatment: str) -> DataFrame:
    """Difference of mean objectives above and below the upper median of a parameter, with Welch's error."""
    order = Window.partitionBy("campaign_id")
    rows = obs.withColumn("at", F.row_number().over(order.orderBy(treatment, "iteration")) - 1).withColumn("n", F.count("*").over(order))
    middle = F.max(F.when(F.col("at") == F.floor(F.col("n") / 2), F.col(treatment))).over(order)
    rows = rows.withColumn("high", F.col(treatment) >= middle)
    part = lambda f, high: f(F.when(F.col("high") == high, F.col("kpi")))
    error = F.sqrt(part(F.var_samp, True) / part(F.count, True) + part(F.var_samp, False) / part(F.count, False))
    return rows.groupBy("campaign_id").agg(tidy(part(F.avg, True) - part(F.avg, False), 4).alias("effect"), tidy(error, 4).alias("error"))

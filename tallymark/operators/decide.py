"""Rules over trials: failure thresholds, safety levels, credibility, weighting, promotion and the next phase."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import clip, tidy
from ..model import Spec


def failure_thresholds(obs: DataFrame, specs: tuple[Spec, ...], splits: int = 10, least_gap: float = 0.3, least_support: int = 3) -> DataFrame:
    """The split of each parameter's range that parts failure rates most, if by more than ``least_gap``.

    All interior splits of all parameters are counted in one aggregation over cumulative bins, not one pass per split.
    """
    bins = F.array(*(F.struct(F.lit(s.name).alias("name"), F.lit(s.lower).alias("low"), F.lit((s.upper - s.lower) / splits).alias("step"), F.col(s.name).alias("x")) for s in specs))
    rows = obs.select("campaign_id", "is_failure", F.inline(bins)).where("x IS NOT NULL")
    # A value exactly at a split counts below it.
    rows = rows.withColumn("bin", F.greatest(F.lit(0), F.least(F.lit(splits - 1), F.ceil(F.round((F.col("x") - F.col("low")) / F.col("step"), 9)) - 1)))
    cells = rows.groupBy("campaign_id", "name", "low", "step", "bin").agg(F.count("*").alias("n"), F.count_if("is_failure").alias("f"))
    every = Window.partitionBy("campaign_id", "name")
    upto = every.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    sums = cells.select("*", F.sum("n").over(upto).alias("nb"), F.sum("f").over(upto).alias("fb"), F.sum("n").over(every).alias("nt"), F.sum("f").over(every).alias("ft"))
    sums = sums.where((F.col("nb") < F.col("nt")) & (F.col("bin") < splits - 1))
    below, above = F.col("fb") / F.col("nb"), (F.col("ft") - F.col("fb")) / (F.col("nt") - F.col("nb"))
    support = F.when(above >= below, F.col("ft") - F.col("fb")).otherwise(F.col("fb"))
    rates = sums.select("campaign_id", "name", (F.col("bin") + 1).cast("int").alias("split"), tidy(F.col("low") + (F.col("bin") + 1) * F.col("step")).alias("threshold"), tidy(below).alias("rate_below"), tidy(above).alias("rate_above"), support.alias("n_supporting"))
    rates = rates.withColumn("gap", tidy(F.abs(F.col("rate_above") - F.col("rate_below")))).where((F.col("gap") > least_gap) & (F.col("n_supporting") >= least_support))
    best = rates.groupBy("campaign_id", "name").agg(F.max_by(F.struct("threshold", "rate_below", "rate_above", "n_supporting"), F.struct("gap", -F.col("split"))).alias("best"))
    return best.select("campaign_id", "name", "best.*")


def safety_levels(obs: DataFrame, limits: dict[str, tuple[float, float]]) -> DataFrame:
    """Each trial's safety: emergency beyond 120 % of a limit or with two in danger, danger beyond one, warning within 10 % of one."""
    danger, warning, worst = F.lit(0), F.lit(0), F.lit(0)
    for name, (low, high) in limits.items():
        x, span = F.col(name), high - low
        out = F.greatest(low - x, x - high)
        danger = danger + F.coalesce((out > 0).cast("int"), F.lit(0))
        warning = warning + F.coalesce(((out <= 0) & (out > -0.1 * span)).cast("int"), F.lit(0))
        worst = worst + F.coalesce((out > 0.2 * span).cast("int"), F.lit(0))
    level = F.when((worst > 0) | (danger > 1), "emergency").when(danger == 1, "danger").when(warning > 0, "warning").otherwise("safe")
    return obs.select("campaign_id", "iteration", level.alias("level"))


def emergency_action(levels: DataFrame, danger_limit: int = 3) -> DataFrame:
    """What a campaign should do, by its counts of levels."""
    n = {k: F.count_if(F.col("level") == k).alias(k) for k in ("emergency", "danger", "warning", "safe")}
    action = F.when((F.col("emergency") > 0) | (F.col("danger") >= danger_limit), "stop").when(F.col("danger") > 0, "fallback").when(F.col("warning") > 0, "pause").otherwise("continue")
    return levels.groupBy("campaign_id").agg(*n.values()).withColumn("action", action)


def credibility(obs: DataFrame) -> DataFrame:
    """A weight for each trial from 0.1 to 1: failures count 0.7, and values far from the campaign's mean less, down to 0.3."""
    every = Window.partitionBy("campaign_id")
    mean, sd = F.avg("kpi").over(every), F.stddev_pop("kpi").over(every)
    outlier = F.coalesce(F.when(sd > 0, F.greatest(F.lit(0.3), 1 - F.abs(F.col("kpi") - mean) / (3 * sd))), F.lit(1.0))
    weight = F.when(F.col("is_failure"), 0.7).otherwise(1.0) * outlier
    return obs.select("campaign_id", "iteration", tidy(clip(weight, 0.1, 1.0)).alias("weight"))


def reject_outliers(obs: DataFrame, sigmas: float = 3.0) -> DataFrame:
    """Trials within ``sigmas`` deviations of their campaign's mean, and those without a value."""
    every = Window.partitionBy("campaign_id")
    far = F.abs(F.col("kpi") - F.avg("kpi").over(every)) > sigmas * F.stddev_pop("kpi").over(every)
    return obs.withColumn("far", F.coalesce(far, F.lit(False))).where("NOT far").drop("far")


def promotions(obs: DataFrame, level: str, share: float = 0.2) -> DataFrame:
    """The best ``share`` of each fidelity level of each campaign, rounded up, the highest level left out."""
    own, every = Window.partitionBy("campaign_id", level), Window.partitionBy("campaign_id")
    place = F.row_number().over(own.orderBy(F.desc("kpi"), "iteration"))
    rows = obs.where("kpi IS NOT NULL").select("campaign_id", "iteration", level, "kpi", place.alias("place"), F.count("*").over(own).alias("n"), F.max(level).over(every).alias("top"))
    return rows.where((F.col(level) < F.col("top")) & (F.col("place") <= F.greatest(F.lit(1), F.ceil(F.col("n") * share)))).select("campaign_id", "iteration", level, "kpi")


def next_phase(signals: DataFrame) -> DataFrame:
    """The campaign's phase by its health signals: the first rule that holds."""
    phase = (
        F.when(F.col("n_trials") < 10, "cold_start")
        .when((F.col("failure_rate") > 0.5) | (F.col("miscalibration_score") > 0.3), "stabilise")
        .when((F.col("kpi_plateau_length") > 0.3 * F.col("n_trials")) & (F.col("exploration_coverage") < 0.5), "explore")
        .when((F.col("convergence_trend") > 0.3) & (F.col("variance_contraction") < 0.7), "exploit")
        .when(F.col("kpi_plateau_length") > 0.5 * F.col("n_trials"), "stop")
        .otherwise("learn")
    )
    return signals.select("campaign_id", phase.alias("phase"))


def distance_to(table: DataFrame, aspirations: dict[str, float], group: list[str]) -> Column:
    """Range-normalised distance of each row to aspired values within its group."""
    d, every = F.lit(0.0), Window.partitionBy(*group)
    for name, goal in aspirations.items():
        span = F.max(name).over(every) - F.min(name).over(every)
        d = d + F.when(span > 0, ((F.col(name) - goal) / span) ** 2).otherwise(0.0)
    return F.sqrt(d)


def name_overlap(a: Column, b: Column) -> Column:
    """Jaccard likeness of two arrays of names; 0 if both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))

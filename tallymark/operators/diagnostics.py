"""The health signals of every campaign: one window stage and one aggregation for all 17.

Windows are dealt by campaign; the recent window is a quarter of the rows (one at least), so its frame depends on the data and
is expressed by row numbers from the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import clip, tidy
from ..model import Spec

RECENT = 0.25
PLATEAU = 0.01
BINS = 10
COVERAGE = 0.9545


def prepared(obs: DataFrame, maximize: bool = True) -> DataFrame:
    """Observations with their places among all rows and among successes, and the best value so far."""
    every = Window.partitionBy("campaign_id")
    line = every.orderBy("iteration")
    ok = F.col("kpi").isNotNull() & ~F.col("is_failure")
    value = F.when(ok, F.col("kpi"))
    best = (F.max if maximize else F.min)(value).over(line.rowsBetween(Window.unboundedPreceding, 0))
    upto = line.rowsBetween(Window.unboundedPreceding, -1)
    out = obs.withColumns({"ok": ok, "value": value, "best": best, "n_all": F.count("*").over(every), "n": F.count(value).over(every)})
    out = out.withColumns({"at_all": F.row_number().over(line), "at": F.count(value).over(line.rowsBetween(Window.unboundedPreceding, 0))})
    out = out.withColumns({"prior_mean": F.avg(value).over(upto), "prior_sd": F.stddev_pop(value).over(upto)})
    size = lambda n: F.greatest(F.floor(n * RECENT), F.lit(1))
    out = out.withColumns({"w": size(F.col("n")), "w_all": size(F.col("n_all"))})
    return out.withColumns({"recent": F.col("ok") & (F.col("at") > F.col("n") - F.col("w")), "recent_all": F.col("at_all") > F.col("n_all") - F.col("w_all"), "early_all": F.col("at_all") <= F.col("w_all")})


def diagnostics(obs: DataFrame, specs: tuple[Spec, ...], maximize: bool = True) -> DataFrame:
    """campaign_id and its 17 signals; undefined signals have their neutral value (0, or 1 for variance_contraction)."""
    rows = prepared(obs, maximize)
    params = [s.name for s in specs]
    good = Window.partitionBy("campaign_id", "ok").orderBy("iteration")
    # The best row so far, and its parameters, among successes.
    leads = F.col("ok") & (F.col("best") == F.col("value")) & F.coalesce(F.lag("best").over(good) != F.col("best"), F.lit(True))
    held = F.struct(*(F.col(p) for p in params))
    rows = rows.withColumn("leader", F.last(F.when(leads, held), ignorenulls=True).over(good.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("jump", F.abs(F.col("best") - F.lag("best").over(good)))
    moved = sum((F.abs(F.col(f"leader.{p}") - F.lag(f"leader.{p}").over(good)) for p in params), F.lit(0.0)) / len(params)
    rows = rows.withColumn("moved", F.when(F.col("recent") & (F.col("at") > F.col("n") - F.col("w") + 1), moved))
    spread = F.max("value").over(Window.partitionBy("campaign_id")) - F.min("value").over(Window.partitionBy("campaign_id"))
    rows = rows.withColumn("spread", spread)
    rows = rows.withColumn("step_at", F.when(F.col("ok") & (F.col("jump") > PLATEAU * F.col("spread")), F.col("at")))
    inside = F.when(F.col("prior_sd") == 0, F.col("value") == F.col("prior_mean")).otherwise(F.abs(F.col("value") - F.col("prior_mean")) <= 2 * F.col("prior_sd"))
    rows = rows.withColumn("inside", F.when(F.col("ok") & (F.col("at") >= 4), inside.cast("double")))

    def cell(s: Spec):
        scaled = clip((F.col(s.name) - s.lower) / (s.upper - s.lower), 0.0, 1.0)
        return F.coalesce(F.least(F.floor(scaled * BINS), F.lit(BINS - 1)), F.lit(-1))

    old = F.col("ok") & ~F.col("recent")
    number = lambda c: F.avg(c.cast("double"))
    out_of_bounds = F.lit(False)
    for s in specs:
        out_of_bounds = out_of_bounds | F.coalesce((F.col(s.name) < s.lower) | (F.col(s.name) > s.upper), F.lit(False))
    sums = rows.groupBy("campaign_id").agg(
        F.first("n").alias("n"),
        F.first("n_all").alias("n_all"),
        F.max("value").alias("hi"),
        F.min("value").alias("lo"),
        F.min_by("value", F.when(F.col("ok"), F.col("at"))).alias("first_value"),
        F.regr_slope(F.when(F.col("ok"), F.col("best")), F.when(F.col("ok"), F.col("iteration").cast("double"))).alias("slope"),
        (F.max(F.when(F.col("ok"), F.col("iteration"))) - F.min(F.when(F.col("ok"), F.col("iteration")))).alias("reach"),
        (F.max(F.when(F.col("recent"), F.col("value"))) - F.min(F.when(F.col("recent"), F.col("value")))).alias("new_range"),
        (F.max(F.when(old, F.col("value"))) - F.min(F.when(old, F.col("value")))).alias("old_range"),
        F.var_pop("value").alias("var_all"),
        F.var_pop(F.when(F.col("recent"), F.col("value"))).alias("var_new"),
        F.avg(F.when(F.col("recent"), F.col("value"))).alias("mean_new"),
        number(F.col("is_failure")).alias("failure_rate"),
        number(F.when(F.col("recent_all"), F.col("is_failure"))).alias("fail_new"),
        number(F.when(F.col("early_all"), F.col("is_failure"))).alias("fail_old"),
        F.avg("moved").alias("moved"),
        F.countDistinct(F.when(~F.col("is_failure"), F.array(*map(cell, specs)))).alias("cells"),
        F.max("step_at").alias("step_at"),
        F.avg("inside").alias("inside"),
        number(out_of_bounds).alias("violations"),
    )
    several = F.col("n") >= 2
    ranged = F.col("hi") - F.col("lo")
    old_range = F.coalesce("old_range", F.lit(0.0))
    total = F.col("new_range") + old_range
    sd_new = F.sqrt("var_new")
    noise = F.when(several & (F.col("mean_new") != 0), sd_new / F.abs("mean_new")).otherwise(0.0)
    outside = 1 - F.col("inside")
    signals = {
        "convergence_trend": F.when(several & (ranged > 0) & (F.col("reach") > 0), clip(F.col("slope") * F.col("reach") / ranged, -1.0, 1.0)).otherwise(0.0),
        "improvement_velocity": F.when(several & (total > 0), clip((F.col("new_range") - old_range) / total, -1.0, 1.0)).otherwise(0.0),
        "variance_contraction": F.when(several & (F.col("var_all") > 0), F.col("var_new") / F.col("var_all")).otherwise(1.0),
        "noise_estimate": noise,
        "failure_rate": F.col("failure_rate"),
        "failure_clustering": F.when(F.col("failure_rate") > 0, F.col("fail_new") / F.col("failure_rate")).otherwise(0.0),
        "feasibility_shrinkage": F.when(F.col("n_all") >= 2, F.col("fail_old") - F.col("fail_new")).otherwise(0.0),
        "parameter_drift": F.coalesce("moved", F.lit(0.0)),
        "model_uncertainty": noise,
        "exploration_coverage": F.col("cells") / float(BINS ** len(specs)),
        "kpi_plateau_length": F.when(~several, 0).when(ranged == 0, F.col("n") - 1).otherwise(F.col("n") - F.coalesce("step_at", F.lit(1))).cast("double"),
        "best_kpi_value": F.coalesce(F.col("hi" if maximize else "lo"), F.lit(0.0)),
        "data_efficiency": F.when(several, (F.col("hi") - F.col("first_value") if maximize else F.col("first_value") - F.col("lo")) / F.col("n_all")).otherwise(0.0),
        "constraint_violation_rate": F.col("violations"),
        "miscalibration_score": F.coalesce(F.least(F.abs(F.col("inside") - COVERAGE), F.lit(1.0)), F.lit(0.0)),
        "overconfidence_rate": F.coalesce(clip((outside - (1 - COVERAGE)) / COVERAGE, 0.0, 1.0), F.lit(0.0)),
        "signal_to_noise_ratio": F.when(~several, 0.0).when(F.col("var_new") == 0, F.when(F.col("mean_new") == 0, 0.0).otherwise(100.0)).otherwise(F.least(F.lit(100.0), F.abs("mean_new") / sd_new)),
    }
    return sums.select("campaign_id", *(tidy(c).alias(k) for k, c in signals.items()))

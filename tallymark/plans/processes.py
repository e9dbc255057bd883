"""Queries on Gaussian processes of campaigns, and on values that do not fit their neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import tidy
from ..model import EVENT_SQL, LINE_SPECS, LINE_SQL, event_observations, line_observations
from ..operators import process, sequence
from .catalogue import PARAMS, _r, query

UNITS = [f"u{i}" for i in range(len(LINE_SPECS))]
NEAR = process.Kernel("rbf", 0.3)
SMOOTH = process.Kernel("matern52", 0.5)


def _unit(rows: DataFrame) -> DataFrame:
    return rows.select("*", *(((F.col(s.name) - s.lower) / (s.upper - s.lower)).alias(u) for u, s in zip(UNITS, LINE_SPECS)))


def _successes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each campaign's successes, parameters on the unit interval, the objective by its campaign's mean and deviation."""
    good = line_observations(spark, sf_dir).where("NOT is_failure AND kpi IS NOT NULL")
    facts = good.groupBy("campaign_id").agg(F.avg("kpi").alias("centre"), F.stddev_pop("kpi").alias("sd")).where("sd > 0")
    return _unit(good.join(facts, "campaign_id")).withColumn("z", (F.col("kpi") - F.col("centre")) / F.col("sd"))


@query()
def gp_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items whose price the supplier's other line items miss by over three deviations."""
    return process.outliers(_successes(spark, sf_dir), "campaign_id", "iteration", UNITS, "z", kernel=NEAR, noise=0.1)


@query()
def gp_row_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices predicted at 16 new points of each campaign, open line items counting as noisier than filled ones."""
    rows = _successes(spark, sf_dir).withColumn("noise", F.when(F.col("m_status") == "O", 0.3).otherwise(0.1))
    points = _unit(sequence.sobol(line_observations(spark, sf_dir), LINE_SPECS, 16))
    told = process.predict(rows, points, "campaign_id", "iteration", "place", UNITS, "z", SMOOTH, "noise")
    return told.select("campaign_id", "place", tidy(F.col("mu"), 5).alias("mu"), tidy(F.col("var"), 5).alias("var"))


@query()
def gp_noise_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a line item's weight changes where open ones count as noisier."""
    rows = _successes(spark, sf_dir).withColumn("noise", F.when(F.col("m_status") == "O", 0.3).otherwise(0.1))
    told = process.noise_impact(rows, "campaign_id", "iteration", UNITS, "z", "noise", SMOOTH)
    return told.select("campaign_id", "iteration", *(tidy(F.col(c), 4).alias(c) for c in ("own_weight", "mean_weight", "ratio")))


@query(f"""+ w AS (SELECT campaign_id, iteration, CASE WHEN count(*) OVER s = 5 THEN var_pop(kpi) OVER s END AS spread FROM obs WHERE kpi IS NOT NULL WINDOW s AS (PARTITION BY campaign_id ORDER BY iteration ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
c AS (SELECT campaign_id, iteration, abs(spread - lag(spread) OVER (PARTITION BY campaign_id ORDER BY iteration)) AS change FROM w),
u AS (SELECT campaign_id, stddev_pop(change) AS usual FROM c WHERE change IS NOT NULL GROUP BY 1)
SELECT campaign_id, iteration, {_r('change / usual', 5)} AS score FROM c JOIN u USING (campaign_id) WHERE usual > 1e-12 AND change > 2 * usual""", EVENT_SQL)
def entropy_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return process.entropy_changes(event_observations(spark, sf_dir), "campaign_id", "iteration", "kpi")


@query(f"""+ ok AS (SELECT * FROM obs WHERE NOT is_failure AND kpi IS NOT NULL),
f AS (SELECT campaign_id, avg(p_quantity) AS mx, avg(kpi) AS my, covar_pop(p_quantity, kpi) / nullif(var_pop(p_quantity), 0) AS slope FROM ok GROUP BY 1),
p AS (SELECT campaign_id, iteration, kpi, my + slope * (p_quantity - mx) AS mu FROM ok JOIN f USING (campaign_id)),
s AS (SELECT campaign_id, sqrt(avg((kpi - mu) * (kpi - mu))) AS sigma FROM p GROUP BY 1)
SELECT campaign_id, iteration, {_r('abs(kpi - mu) / sigma', 5)} AS residual FROM p JOIN s USING (campaign_id) WHERE sigma > 0 AND round(abs(kpi - mu) / sigma, 5) > 1.7""", LINE_SQL)
def residual_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items whose price is far from their supplier's line over quantity."""
    good = line_observations(spark, sf_dir).where("NOT is_failure AND kpi IS NOT NULL")
    x, y = F.col(PARAMS[0]), F.col("kpi")
    facts = good.groupBy("campaign_id").agg(F.avg(x).alias("mx"), F.avg(y).alias("my"), F.try_divide(F.covar_pop(x, y), F.var_pop(x)).alias("slope"))
    told = good.join(facts, "campaign_id").withColumn("mu", F.col("my") + F.col("slope") * (x - F.col("mx")))
    spread = told.groupBy("campaign_id").agg(F.sqrt(F.avg((y - F.col("mu")) * (y - F.col("mu")))).alias("sigma"))
    return process.residual_outliers(told.join(spread, "campaign_id"), "kpi", "mu", "sigma", 1.7).select("campaign_id", "iteration", "residual")

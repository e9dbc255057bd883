"""The trial store: filtered scans, key lookups, summaries and column discovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import tidy


def query(obs: DataFrame, campaign: int | None = None, iterations: tuple[int, int] | None = None, only_successful: bool = False) -> DataFrame:
    """Rows that meet every given predicate; all of them reach the scan."""
    if campaign is not None:
        obs = obs.where(F.col("campaign_id") == campaign)
    if iterations is not None:
        obs = obs.where(F.col("iteration").between(*iterations))
    return obs.where(~F.col("is_failure")) if only_successful else obs


def column_values(obs: DataFrame, *names: str) -> DataFrame:
    """The first of ``names`` a row has a value for; rows without any are skipped."""
    return obs.select("campaign_id", "iteration", F.coalesce(*names).alias("value")).where(F.col("value").isNotNull())


def summary(obs: DataFrame) -> DataFrame:
    """Counts and iteration bounds of each campaign."""
    return obs.groupBy("campaign_id").agg(
        F.count("*").alias("n_rows"),
        F.count_if(~F.col("is_failure")).alias("n_successful"),
        F.count_if("is_failure").alias("n_failed"),
        F.min("iteration").alias("first_iteration"),
        F.max("iteration").alias("last_iteration"),
    )


def campaigns(obs: DataFrame) -> DataFrame:
    return obs.select("campaign_id").distinct()


def long_form(obs: DataFrame, names: list[str]) -> DataFrame:
    """One row per observation and named value; the shape for every per-parameter operator."""
    kept = [c for c in obs.columns if c not in names]
    return obs.unpivot(kept, names, "name", "x")


def column_profile(table: DataFrame, names: list[str]) -> DataFrame:
    """Per column: counts of values, nulls and distinct values, and bounds, mean and deviation."""
    wide = table.select(*(F.col(c).cast("double").alias(c) for c in names)).unpivot([], names, "name", "x")
    return wide.groupBy("name").agg(
        F.count("x").alias("n_values"),
        F.count_if(F.col("x").isNull()).alias("n_nulls"),
        F.countDistinct("x").alias("n_unique"),
        tidy(F.min("x")).alias("min_value"),
        tidy(F.max("x")).alias("max_value"),
        tidy(F.avg("x"), 4).alias("mean_value"),
        tidy(F.stddev_pop("x"), 4).alias("std_value"),
    )


def infer_types(table: DataFrame, names: list[str]) -> DataFrame:
    """The narrowest of integer, float, boolean and string that every non-blank text of a column has, else mixed."""
    text = table.select(*(F.trim(F.col(c).cast("string")).alias(c) for c in names)).unpivot([], names, "name", "x").where("x IS NOT NULL AND x <> ''")
    whole = F.col("x").rlike(r"^[+-]?[0-9]+$")
    number = F.expr("try_cast(x AS double)").isNotNull()
    truth = F.lower("x").isin("true", "false")
    seen = text.groupBy("name").agg(F.count("*").alias("n"), F.count_if(whole).alias("i"), F.count_if(number).alias("f"), F.count_if(truth).alias("b"))
    kind = F.when(F.col("i") == F.col("n"), "integer").when(F.col("f") == F.col("n"), "float").when(F.col("b") == F.col("n"), "boolean").when((F.col("f") > 0) | (F.col("b") > 0), "mixed").otherwise("string")
    return seen.select("name", F.col("n").alias("n_values"), kind.alias("kind"))


def infer_roles(obs: DataFrame, names: list[str]) -> DataFrame:
    """The role of each column by its name and distinctness."""
    stats = column_profile(obs, names)
    low = F.lower("name")
    role = (
        F.when(low.rlike("^(iter|iteration|step|trial)"), "iteration")
        .when(low.rlike("(time|date|^ts$)"), "timestamp")
        .when(low.rlike("^(kpi|objective|obj)") | low.rlike("(yield|price|score)$"), "kpi")
        .when(low.rlike("(_id|key|^id)$"), "identifier")
        .when(low.rlike("^m_"), "metadata")
        .when(low.rlike("^p_") | (F.col("n_unique") > 1), "parameter")
        .otherwise("unknown")
    )
    return stats.select("name", "n_values", "n_unique", role.alias("role"))


def iqr_anomalies(obs: DataFrame, name: str = "kpi", factor: float = 1.5) -> DataFrame:
    """Rows beyond ``factor`` interquartile ranges of their campaign's quartiles."""
    cuts = obs.groupBy("campaign_id").agg(F.percentile(name, F.lit(0.25)).alias("q1"), F.percentile(name, F.lit(0.75)).alias("q3"))
    gap = (F.col("q3") - F.col("q1")) * factor
    joined = obs.join(cuts, "campaign_id")
    return joined.where((F.col(name) < F.col("q1") - gap) | (F.col(name) > F.col("q3") + gap)).select("campaign_id", "iteration", tidy(F.col(name)).alias("value"))


def missing_report(table: DataFrame, names: list[str]) -> DataFrame:
    """Nulls and their share by column."""
    agg = table.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in names), F.count("*").alias("n_rows"))
    return agg.unpivot(["n_rows"], names, "name", "n_missing").select("name", "n_missing", tidy(F.try_divide("n_missing", "n_rows")).alias("share"))


def top_k(table: DataFrame, value: str, ties: list[str], k: int, by: list[str] | None = None, descending: bool = True) -> DataFrame:
    """The ``k`` best rows, of each group of ``by`` if given, with their rank; ties in the order of ``ties``."""
    order = [F.col(value).desc() if descending else F.col(value).asc(), *ties]
    if by is None:
        best = table.orderBy(*order).limit(k)
        return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    return table.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def ranking(table: DataFrame, by: str, value: str, ties: str) -> DataFrame:
    """The place of every row among its group."""
    return table.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.col(value).desc(), ties)))


def zscore_outliers(obs: DataFrame, name: str = "kpi", sigmas: float = 2.0) -> DataFrame:
    """Rows more than ``sigmas`` population deviations from their campaign's mean."""
    stats = obs.groupBy("campaign_id").agg(F.avg(name).alias("m"), F.stddev_pop(name).alias("s"))
    z = (F.col(name) - F.col("m")) / F.col("s")
    return obs.join(stats, "campaign_id").where(F.col("s") > 0).withColumn("z", z).where(F.abs("z") > sigmas).select("campaign_id", "iteration", tidy(F.col("z"), 5).alias("z"))


def keep_in_box(obs: DataFrame, bounds: dict[str, tuple[float, float]]) -> Column:
    """Whether a row is inside all bounds; a missing value passes."""
    inside = F.lit(True)
    for name, (low, high) in bounds.items():
        inside = inside & F.coalesce(F.col(name).between(low, high), F.lit(True))
    return inside

"""Running many campaigns: comparisons, queues and schedules, stopping, portfolios, and search over records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import tidy
from .windows import numbered


def compare_campaigns(obs: DataFrame, kind: str, kinds: list[str], maximize: bool = True) -> DataFrame:
    """Each campaign's best value of every kind side by side, and its place by the best of all."""
    best = (F.max if maximize else F.min)("kpi")
    wide = obs.groupBy("campaign_id").pivot(kind, kinds).agg(best)
    every = (F.greatest if maximize else F.least)(*(F.col(k) for k in kinds))
    told = numbered(wide.withColumn("every_", every), F.col("every_").desc_nulls_last() if maximize else F.col("every_").asc_nulls_last(), F.col("campaign_id").asc())
    return told.withColumn("place", F.col("place").cast("int")).drop("every_")


def status_counts(table: DataFrame, by: str, status: str, statuses: list[str]) -> DataFrame:
    """Rows of each group by status."""
    return table.groupBy(by).agg(F.count("*").alias("total"), *(F.count_if(F.col(status) == s).alias(f"n_{s}") for s in statuses))


def schedule(jobs: DataFrame, by: str, key: str, duration: str, parallel: int) -> DataFrame:
    """Jobs of each group in batches of ``parallel``, longest first, with the time at which each batch starts."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(duration), key)) - 1
    rows = jobs.select(by, key, duration, F.floor(place / parallel).alias("batch"))
    longest = rows.groupBy(by, "batch").agg(F.max(duration).alias("lasts"))
    before = F.coalesce(F.sum("lasts").over(Window.partitionBy(by).orderBy("batch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    starts = longest.select(by, "batch", tidy(before, 2).alias("starts"))
    return rows.join(starts, [by, "batch"]).select(by, key, "batch", "starts")


def stop_at(obs: DataFrame, patience: int, least_gain: float, most: int) -> DataFrame:
    """The first trial at which a campaign should stop, and why: its trial limit, or no gain over ``patience`` trials."""
    line = Window.partitionBy("campaign_id").orderBy("iteration")
    best = F.max(F.when(~F.col("is_failure"), F.col("kpi"))).over(line.rowsBetween(Window.unboundedPreceding, 0))
    rows = obs.select("campaign_id", "iteration", best.alias("best"))
    rows = rows.withColumn("past", F.lag("best", patience).over(line))
    why = F.when(F.col("iteration") + 1 >= most, "trials").when(F.col("best") - F.col("past") < least_gain, "stagnation")
    hit = rows.withColumn("why", why).where("why IS NOT NULL")
    return hit.groupBy("campaign_id").agg(F.min_by(F.struct("iteration", "why"), "iteration").alias("at")).select("campaign_id", "at.*")


def lag1_autocorrelation(obs: DataFrame) -> DataFrame:
    """Correlation of neighbouring objectives about the campaign's mean."""
    every = Window.partitionBy("campaign_id")
    rows = obs.select("campaign_id", "iteration", (F.col("kpi") - F.avg("kpi").over(every)).alias("d"))
    rows = rows.withColumn("before", F.lag("d").over(every.orderBy("iteration")))
    power = F.sum(F.col("d") * F.col("d"))
    return rows.groupBy("campaign_id").agg(tidy(F.coalesce(F.when(power > 0, F.sum(F.col("d") * F.col("before")) / power), F.lit(0.0))).alias("r1"))


def smoothed(obs: DataFrame, rate: float) -> DataFrame:
    """The exponential moving average of each campaign's objective after its last trial: an ordered fold, from its first value.

    A fold of one campaign's values in order; the trials of a campaign are its group, as everywhere here.
    """
    series = obs.where("kpi IS NOT NULL").groupBy("campaign_id").agg(F.array_sort(F.collect_list(F.struct("iteration", "kpi"))).alias("s"))
    first = F.get("s", F.lit(0))["kpi"]
    fold = F.aggregate(F.slice("s", F.lit(2), F.greatest(F.size("s") - 1, F.lit(0))), first, lambda acc, v: acc * (1 - rate) + v["kpi"] * rate)
    return series.select("campaign_id", tidy(fold).alias("ema"))


def search_records(records: DataFrame, key: str, title: str, views: str, words: list[str], limit: int) -> DataFrame:
    """Records whose title holds any of the words, most viewed first: a top-k report."""
    found = F.lit(False)
    for w in words:
        found = found | F.lower(title).contains(w.lower())
    return records.where(found).orderBy(F.desc(views), key).limit(limit).select(key, views)


def rank_backends(outcomes: DataFrame, fingerprint: str, backend: str, won: Column, failed: Column) -> DataFrame:
    """Backends by fingerprint: win rate, trusted by count up to five, less the failure rate."""
    score = F.avg(won.cast("double")) * F.least(F.lit(1.0), F.count("*") / 5) - F.avg(failed.cast("double"))
    rows = outcomes.groupBy(fingerprint, backend).agg(F.count("*").alias("n"), tidy(score).alias("score"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(fingerprint).orderBy(F.desc("score"), backend)))


def decision_stability(table: DataFrame, by: str, key: str, value: str, noise: float) -> DataFrame:
    """Of each group's ranking, the neighbours whose margin is within the noise (a fraction of the range)."""
    line, every = Window.partitionBy(by).orderBy(F.desc(value), key), Window.partitionBy(by)
    span = F.max(value).over(every) - F.min(value).over(every)
    rows = table.select(by, F.row_number().over(line).alias("rank"), (F.col(value) - F.lead(value).over(line)).alias("margin"), span.alias("span")).where("margin IS NOT NULL")
    return rows.groupBy(by).agg(F.count("*").alias("n_margins"), F.count_if(F.col("margin") < noise * F.col("span")).alias("n_unstable"), tidy(F.max(F.when(F.col("rank") == 1, F.col("margin"))), 4).alias("top_margin"))

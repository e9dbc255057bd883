"""Paired tests, ensembles and model comparison as aggregations."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import norm_cdf, safe_corr, tidy


def wilcoxon(pairs: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """The signed-rank statistic of each group's pairs (equal pairs left out, ties at mean ranks) and its normal p-value."""
    d = pairs.select(group, (F.col(x) - F.col(y)).alias("d")).where(F.abs("d") > 1e-12)
    size = F.round(F.abs("d"), 9)
    d = d.withColumn("size", size)
    line = Window.partitionBy(group).orderBy("size")
    ranked = d.withColumn("rank", F.rank().over(line) + (F.count("*").over(Window.partitionBy(group, "size")) - 1) / 2)
    sums = ranked.groupBy(group).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.when(F.col("d") > 0, F.col("rank"))), F.lit(0.0)).alias("w_plus"))
    n = F.col("n")
    z = F.abs(F.col("w_plus") - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24)
    return sums.select(group, n.alias("n_pairs"), tidy(F.col("w_plus"), 4).alias("w_plus"), tidy(2 * (1 - norm_cdf(z)), 5).alias("p_value"))


def ensemble_confidence(predictions: DataFrame, item: str, value: str) -> DataFrame:
    """Per item the mean and sample deviation over models, and their agreement 1 / (1 + deviation)."""
    sd = F.coalesce(F.stddev_samp(value), F.lit(0.0))
    return predictions.groupBy(item).agg(F.count(value).alias("n_models"), F.avg(value).alias("mean_value"), tidy(1 / (1 + sd), 9).alias("agreement"))


def correlation_matrix(table: DataFrame, names: list[str]) -> DataFrame:
    """Correlation of every pair of columns, all in one aggregation."""
    pairs = list(combinations(names, 2))
    one = table.agg(*(tidy(safe_corr(F.col(a), F.col(b)), 6).alias(f"{a}|{b}") for a, b in pairs))
    rows = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}|{b}").alias("r")) for a, b in pairs))
    return one.select(F.inline(rows))


def skeleton(table: DataFrame, names: list[str], level: float = 0.05) -> DataFrame:
    """The undirected skeleton of the PC algorithm with conditioning sets of at most one variable.

    The data is read once, for its correlations and count; the tests are arithmetic on that matrix, whose size is the square of the
    number of variables.
    """
    pairs = correlation_matrix(table, names).withColumn("n", F.lit(table.count()))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "r", "n"))
    third = pairs.alias("p").join(both.alias("q"), (F.col("q.a") == F.col("p.a")) & (F.col("q.b") != F.col("p.b")), "left").join(both.alias("s"), (F.col("s.a") == F.col("p.b")) & (F.col("s.b") == F.col("q.b")), "left")
    base = (1 - F.col("q.r") * F.col("q.r")) * (1 - F.col("s.r") * F.col("s.r"))
    partial = F.when(base > 1e-12, (F.col("p.r") - F.col("q.r") * F.col("s.r")) / F.sqrt(base)).otherwise(0.0)
    cut = lambda r: F.least(F.greatest(r, F.lit(-0.999999)), F.lit(0.999999))
    z = lambda r, given: F.abs(0.5 * F.ln((1 + cut(r)) / (1 - cut(r)))) * F.sqrt(F.greatest(F.col("p.n") - given - 3, F.lit(0)))
    p = lambda r, given: 2 * (1 - norm_cdf(z(r, given)))
    weak = F.greatest(p(F.col("p.r"), 0), F.coalesce(p(partial, 1), F.lit(0.0)))
    worst = third.groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.max(weak).alias("p"), F.first("p.r").alias("r"))
    return worst.where(F.col("p") <= level).select("a", "b", "r")


def compare_models(table: DataFrame, group: str, y: str, predictors: list[str]) -> DataFrame:
    """One-variable linear models of each group ranked by BIC, with the evidence against each relative to the best."""
    parts = F.array(*(F.struct(F.lit(p).alias("model"), F.col(p).alias("x")) for p in predictors))
    rows = table.select(group, F.col(y).alias("y"), F.inline(parts)).where("x IS NOT NULL AND y IS NOT NULL")
    fit = rows.groupBy(group, "model").agg(F.count("*").alias("n"), F.regr_syy("y", "x").alias("syy"), F.regr_sxx("y", "x").alias("sxx"), F.regr_sxy("y", "x").alias("sxy"))
    rss = F.greatest(F.col("syy") - F.coalesce(F.try_divide(F.col("sxy") * F.col("sxy"), F.col("sxx")), F.lit(0.0)), F.lit(1e-12))
    bic = fit.select(group, "model", tidy(F.col("n") * F.ln(rss / F.col("n")) + 2 * F.ln("n"), 4).alias("bic"))
    every = Window.partitionBy(group)
    place = F.row_number().over(every.orderBy("bic", "model"))
    return bic.select(group, "model", "bic", place.alias("rank"), tidy(F.least(F.exp((F.col("bic") - F.min("bic").over(every)) / 2), F.lit(1e6)), 3).alias("evidence_against"))

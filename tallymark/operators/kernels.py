"""Numeric kernels that SQL cannot express, one Arrow group per campaign: surrogates, samplers, change points, resampling.

Each kernel is a small numpy function; Spark deals the campaigns out.  Seeds come from the campaign's id, so reruns agree.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import norm_cdf, norm_pdf
from ..model import Spec
from ..sources.tables import keep
from . import process
from .prefer import unit


def _unit(pdf: pd.DataFrame, specs: tuple[Spec, ...]) -> np.ndarray:
    return np.column_stack([(pdf[s.name].to_numpy(dtype=float) - s.lower) / (s.upper - s.lower) for s in specs])


def _latin(rng: np.random.Generator, n: int, d: int) -> np.ndarray:
    """One point in each of n strata of every dimension."""
    return (np.column_stack([rng.permutation(n) for _ in range(d)]) + rng.random((n, d))) / n


def _frame(campaign: int, points: np.ndarray, specs: tuple[Spec, ...], **more: np.ndarray) -> pd.DataFrame:
    out = {"campaign_id": campaign, "place": np.arange(len(points))}
    out |= {s.name: s.lower + points[:, i] * (s.upper - s.lower) for i, s in enumerate(specs)}
    return pd.DataFrame(out | more)


def _schema(specs: tuple[Spec, ...], *more: str) -> str:
    return ", ".join(["campaign_id long", "place long", *(f"{s.name} double" for s in specs), *more])


def latin_hypercube(obs: DataFrame, specs: tuple[Spec, ...], n: int, seed: int = 42) -> DataFrame:
    """``n`` stratified starting points for every campaign."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return _frame(key[0], _latin(np.random.default_rng([seed, key[0]]), n, len(specs)), specs)

    return obs.select("campaign_id").distinct().groupBy("campaign_id").applyInPandas(run, _schema(specs))


def random_points(obs: DataFrame, specs: tuple[Spec, ...], n: int, seed: int = 42) -> DataFrame:
    """``n`` uniform points for every campaign, drawn by hashing, so without leaving the JVM."""
    rows = obs.select("campaign_id").distinct().withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("place", F.col("place").cast("long"))
    drawn = lambda i: unit(F.lit(seed), F.col("campaign_id"), F.col("place"), F.lit(i))
    return rows.select("campaign_id", "place", *((F.lit(s.lower) + drawn(i) * (s.upper - s.lower)).alias(s.name) for i, s in enumerate(specs)))


def halton(obs: DataFrame, specs: tuple[Spec, ...], n: int, skip: int = 42) -> DataFrame:
    """A low-discrepancy sequence for every campaign: the radical inverse of a point's number in one prime base per parameter."""
    bases = [p for p in range(2, 200) if all(p % q for q in range(2, int(p**0.5) + 1))]

    def inverse(number, base: int):
        digits = F.sequence(F.lit(1), F.lit(32))
        digit = lambda k: F.pmod(F.floor(number / F.pow(F.lit(float(base)), k - 1)), F.lit(base)) / F.pow(F.lit(float(base)), k)
        return F.aggregate(digits, F.lit(0.0), lambda acc, k: acc + digit(k))

    rows = obs.select("campaign_id").distinct().withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("place", F.col("place").cast("long"))
    return rows.select("campaign_id", "place", *((F.lit(s.lower) + inverse(F.col("place") + skip + 1, bases[i]) * (s.upper - s.lower)).alias(s.name) for i, s in enumerate(specs)))


def _ranked(obs: DataFrame, specs: tuple[Spec, ...]) -> DataFrame:
    """Successes by their rank, from 1, in their campaign: best first, then earlier ones; one that is no number is last."""
    good = obs.where("NOT is_failure AND kpi IS NOT NULL").select("campaign_id", "iteration", "kpi", *(s.name for s in specs))
    worth = F.nanvl(F.col("kpi").cast("double"), F.lit(float("-inf")))
    return good.withColumn("rank", F.row_number().over(Window.partitionBy("campaign_id").orderBy(worth.desc(), "iteration")))


def _best(obs: DataFrame, specs: tuple[Spec, ...], most: int) -> DataFrame:
    """Each campaign's ``most`` best successes, of which each task sends that many at most."""
    return _ranked(obs, specs).where(F.col("rank") <= most).drop("rank")


def suggest_evolution(obs: DataFrame, specs: tuple[Spec, ...], n: int = 3, factor: float = 0.8, cross: float = 0.9, most: int = 50, seed: int = 42) -> DataFrame:
    """Differential evolution (rand/1/bin) from each campaign's ``most`` best successes."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng([seed, key[0]])
        x = _unit(pdf.sort_values(["kpi", "iteration"], ascending=[False, True]).head(most), specs)
        if len(x) < 4:
            return _frame(key[0], rng.random((n, len(specs))), specs)
        out = []
        for _ in range(n):
            i, a, b, c = rng.choice(len(x), 4, replace=False)
            swap = rng.random(len(specs)) < cross
            swap[rng.integers(len(specs))] = True
            out.append(np.clip(np.where(swap, x[a] + factor * (x[b] - x[c]), x[i]), 0, 1))
        return _frame(key[0], np.array(out), specs)

    return _best(obs, specs, most).groupBy("campaign_id").applyInPandas(run, _schema(specs))


def suggest_covariance(obs: DataFrame, specs: tuple[Spec, ...], n: int = 3, most: int = 200, seed: int = 42) -> DataFrame:
    """One step of covariance-matrix adaptation: draws about the weighted mean of the better half, with its covariance."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng([seed, key[0]])
        x = _unit(pdf.sort_values(["kpi", "iteration"], ascending=[False, True]).head(most), specs)
        top = x[: max(1, len(x) // 2)]
        w = np.log(len(top) + 0.5) - np.log(np.arange(1, len(top) + 1))
        w /= w.sum()
        mean = w @ top
        spread = (top - mean).T @ ((top - mean) * w[:, None]) + 1e-6 * np.eye(len(specs))
        return _frame(key[0], np.clip(rng.multivariate_normal(mean, spread, n), 0, 1), specs)

    return _best(obs, specs, most).groupBy("campaign_id").applyInPandas(run, _schema(specs))


def suggest_gp(obs: DataFrame, specs: tuple[Spec, ...], n: int = 3, pool: int = 256, most: int = 1000, noise: float = 1e-3, seed: int = 42, block: int = process.BLOCK) -> DataFrame:
    """Per campaign the ``n`` candidates of highest expected improvement (maximising) under an exact Gaussian process of all its successes.

    A campaign of up to ``most`` successes is one task's; the covariance of a larger one is decomposed in blocks (``process``), to the same result.
    """
    kernel = process.Kernel("rbf", 0.3)
    units = [f"u{i}" for i in range(len(specs))]

    def drawn(campaign: int) -> np.ndarray:
        return _latin(np.random.default_rng([seed, campaign]), pool, len(specs))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("iteration")
        x, y = _unit(pdf, specs), pdf["kpi"].to_numpy(dtype=float)
        sd = y.std() or 1.0
        z = (y - y.mean()) / sd
        points = drawn(key[0])
        chol = np.linalg.cholesky(kernel.between(x, x) + noise * np.eye(len(x)))
        cross = np.linalg.solve(chol, kernel.between(x, points))
        mean = cross.T @ np.linalg.solve(chol, z)
        sigma = np.sqrt(np.maximum(1 - (cross**2).sum(axis=0), 1e-12))
        u = (mean - z.max()) / sigma
        cdf = 0.5 * (1 + np.vectorize(math.erf)(u / np.sqrt(2)))
        gain = (mean - z.max()) * cdf + sigma * np.exp(-u * u / 2) / np.sqrt(2 * np.pi)
        best = np.argsort(-gain, kind="stable")[:n]
        return _frame(key[0], points[best], specs, mean=mean[best] * sd + y.mean(), sigma=sigma[best] * sd, gain=gain[best] * sd)

    def candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for campaign in pdf["campaign_id"]:
                yield pd.DataFrame(drawn(campaign), columns=units).assign(campaign_id=campaign, number=np.arange(pool))[["campaign_id", "number", *units]]

    schema = _schema(specs, "mean double", "sigma double", "gain double")
    good = obs.where("NOT is_failure AND kpi IS NOT NULL").select("campaign_id", "iteration", "kpi", *(s.name for s in specs))
    facts = good.groupBy("campaign_id").agg(F.count("*").alias("n"), F.avg("kpi").alias("centre"), F.stddev_pop("kpi").alias("sd"), F.max("kpi").alias("top"))
    facts = keep(facts.withColumn("sd", F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0)), "gp-facts")
    large = facts.where(F.col("n") > most)
    small = good.join(large.select("campaign_id"), "campaign_id", "left_anti").groupBy("campaign_id").applyInPandas(run, schema)
    if large.isEmpty():
        return small
    rows = good.join(large, "campaign_id").select("campaign_id", "iteration", ((F.col("kpi") - F.col("centre")) / F.col("sd")).alias("z"), *(((F.col(s.name) - s.lower) / (s.upper - s.lower)).alias(u) for s, u in zip(specs, units)))
    points = keep(large.select("campaign_id").mapInPandas(candidates, "campaign_id long, number long, " + ", ".join(f"{u} double" for u in units)), "gp-points")
    told = process.predict(rows, points, "campaign_id", "iteration", "number", units, "z", kernel, noise, block)
    told = told.join(points, ["campaign_id", "number"]).join(large, "campaign_id").withColumn("sigma", F.sqrt("var"))
    gap = F.col("mu") - (F.col("top") - F.col("centre")) / F.col("sd")
    told = told.withColumn("gain", gap * norm_cdf(gap / F.col("sigma")) + F.col("sigma") * norm_pdf(gap / F.col("sigma")))
    told = told.withColumn("place", F.row_number().over(Window.partitionBy("campaign_id").orderBy(F.desc("gain"), "number")) - 1).where(F.col("place") < n)
    scaled = [(F.lit(s.lower) + F.col(u) * (s.upper - s.lower)).alias(s.name) for s, u in zip(specs, units)]
    told = told.select("campaign_id", F.col("place").cast("long").alias("place"), *scaled, (F.col("mu") * F.col("sd") + F.col("centre")).alias("mean"), (F.col("sigma") * F.col("sd")).alias("sigma"), (F.col("gain") * F.col("sd")).alias("gain"))
    return small.unionByName(told)


def suggest_tpe(obs: DataFrame, specs: tuple[Spec, ...], n: int = 3, share: float = 0.25, width: float = 0.1, seed: int = 42) -> DataFrame:
    """Jitter around ``n`` successes drawn from each campaign's best quarter.

    The ranks to take and the jitter are drawn by a campaign's number of successes alone; only rows of these ranks are read on.
    """

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for campaign, count in zip(pdf["campaign_id"], pdf["n"]):
                rng = np.random.default_rng([seed, campaign])
                rank = rng.integers(0, max(1, int(count * share)), n) + 1
                yield pd.DataFrame({"campaign_id": campaign, "place": np.arange(n), "rank": rank, "jitter": list(rng.normal(0, width, (n, len(specs))))})

    ranked = _ranked(obs, specs)
    picked = ranked.groupBy("campaign_id").agg(F.count("*").alias("n")).mapInPandas(draw, "campaign_id long, place long, rank int, jitter array<double>")
    near = lambda i, s: F.least(F.greatest((F.col(s.name) - s.lower) / (s.upper - s.lower) + F.get("jitter", F.lit(i)), F.lit(0.0)), F.lit(1.0))
    return picked.join(ranked, ["campaign_id", "rank"]).select("campaign_id", "place", *((F.lit(s.lower) + near(i, s) * (s.upper - s.lower)).alias(s.name) for i, s in enumerate(specs)))


def bootstrap_mean(obs: DataFrame, rounds: int = 200, level: float = 0.95) -> DataFrame:
    """Percentile interval of each campaign's mean by the Poisson bootstrap: weights are hashed per row and round, so it needs one
    aggregation and no group ever meets in a task."""
    draws = F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("round")
    rows = obs.where(~F.col("is_failure")).select("campaign_id", "iteration", "kpi", draws)
    u = (F.pmod(F.xxhash64("campaign_id", "iteration", "round"), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    steps, mass, total = F.lit(0), 1.0, 0.0
    for k in range(8):
        mass = np.exp(-1.0) if k == 0 else mass / k
        total += float(mass)
        steps = steps + (u > total).cast("int")
    means = rows.withColumn("weight", steps).groupBy("campaign_id", "round").agg((F.sum(F.col("kpi") * F.col("weight")) / F.sum("weight")).alias("mean"))
    tail = (1 - level) / 2
    return means.groupBy("campaign_id").agg(F.avg("mean").alias("mean"), F.percentile("mean", F.lit(tail)).alias("low"), F.percentile("mean", F.lit(1 - tail)).alias("high"))


def change_points(obs: DataFrame, hazard: float = 0.01, threshold: float = 0.5, horizon: int = 200) -> DataFrame:
    """Bayesian online change-point detection on each campaign's objective, run lengths beyond ``horizon`` pooled in the last.

    Trials stream through their task in order; what it keeps of a campaign is the belief about each run length.  Trials without a campaign take no part.
    """

    gamma = np.vectorize(math.lgamma)
    # A normal-gamma belief about mean and precision for each run length; its predictive is Student's t.
    fresh = (0.0, 1.0, 1.0, 0.1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        campaign = None
        for pdf in batches:
            found = []
            for now, iteration, x in zip(pdf["campaign_id"], pdf["iteration"], pdf["z"]):
                if now != campaign:
                    campaign, t, last, p, belief = now, 0, 0, np.ones(1), [np.full(1, v) for v in fresh]
                mean, kappa, alpha, beta = belief
                width = beta * (kappa + 1) / (alpha * kappa)
                log_like = gamma(alpha + 0.5) - gamma(alpha) - 0.5 * np.log(2 * np.pi * alpha * width) - (alpha + 0.5) * np.log1p((x - mean) ** 2 / (2 * alpha * width))
                like = p * np.exp(log_like)
                p = np.r_[like.sum() * hazard, like * (1 - hazard)]
                p /= p.sum() or 1.0
                grown = ((kappa * mean + x) / (kappa + 1), kappa + 1, alpha + 0.5, beta + kappa * (x - mean) ** 2 / (2 * (kappa + 1)))
                belief = [np.r_[v, g] for v, g in zip(fresh, grown)]
                if len(p) > horizon:
                    p[-2] += p[-1]
                    p, belief = p[:-1], [v[:-1] for v in belief]
                top = int(p.argmax())
                if (last >= 3 and top <= 1) or (t >= 3 and p[:2].sum() > threshold):
                    found.append((campaign, iteration, float(p[:2].sum())))
                last, t = top, t + 1
            yield pd.DataFrame(found, columns=["campaign_id", "iteration", "probability"])

    valid = obs.where("kpi IS NOT NULL").select("campaign_id", "iteration", F.col("kpi").cast("double").alias("kpi"))
    facts = valid.groupBy("campaign_id").agg(F.avg("kpi").alias("centre"), F.stddev_pop("kpi").alias("sd"))
    scaled = valid.join(facts, "campaign_id").select("campaign_id", "iteration", ((F.col("kpi") - F.col("centre")) / F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0)).alias("z"))
    # A number of partitions of its own: trials are small, what is done with each is not.
    tasks = int(obs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return scaled.repartition(tasks, "campaign_id").sortWithinPartitions("campaign_id", "iteration").mapInPandas(run, "campaign_id long, iteration long, probability double")


def diversify(candidates: DataFrame, specs: tuple[Spec, ...], n: int) -> DataFrame:
    """A greedy subset of each campaign's candidates with the largest least distance, from the one of the least place; equal distances go by place.

    Each round is one aggregation: every candidate's least distance to those chosen, at most ``n`` vectors a campaign, and the largest of them.
    """
    whole = F.struct(*(F.col(c) for c in candidates.columns))
    at = F.array(*((F.col(s.name).cast("double") - s.lower) / (s.upper - s.lower) for s in specs))
    rows = keep(candidates.where("campaign_id IS NOT NULL").select("campaign_id", "place", whole.alias("row_"), at.alias("at_")), "diverse-rows")
    first = rows.groupBy("campaign_id").agg(F.count("*").alias("n_"), F.min_by(F.struct("row_", "at_"), "place").alias("best_"))
    chosen = keep(first.select("campaign_id", "n_", F.array("best_").alias("chosen_")), "diverse")
    gap = lambda c: F.aggregate(F.zip_with("at_", c["at_"], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    for taken in range(1, n):
        least = F.array_min(F.transform("chosen_", gap))
        best = rows.join(chosen.where(F.col("n_") > taken), "campaign_id").groupBy("campaign_id").agg(F.max_by(F.struct("row_", "at_"), F.struct(least, -F.col("place"))).alias("best_"))
        more = F.when(F.col("best_").isNull(), F.col("chosen_")).otherwise(F.concat("chosen_", F.array("best_")))
        chosen = keep(chosen.join(best, "campaign_id", "left").select("campaign_id", "n_", more.alias("chosen_")), "diverse")
    return chosen.select(F.explode("chosen_").alias("c_")).select("c_.row_.*")

"""Exact Gaussian processes of campaigns of any size: a Cholesky decomposition in blocks, dealt out over tasks.

The covariance of a campaign's rows is never held whole.  Its blocks of ``BLOCK`` rows are made from the parameters where they are
needed, and the decomposition goes over block columns: step k subtracts the products of the columns before, factors the block on
the diagonal and turns the blocks below it.  Rows that are no training rows (the unit matrix for leaving one out, covariances of new points) walk
along and come out multiplied by the inverse factor, which is all that predictions need.  A task holds some blocks, never a campaign;
campaigns of one block need one step and write no block at all when one is left out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import tidy
from ..sources.tables import keep

BLOCK = 512
# Products that one task adds up before their sums are added up.
SPAN = 16
LEAST_NOISE = 1e-8


@dataclass(frozen=True)
class Kernel:
    """A covariance that falls with distance: ``rbf`` or ``matern52``, with its length and the variance at distance 0."""

    name: str = "rbf"
    length: float = 1.0
    signal: float = 1.0

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        gap = sum(((a[:, i, None] - b[None, :, i]) ** 2 for i in range(a.shape[1])), np.zeros((len(a), len(b)))) / self.length**2
        if self.name == "rbf":
            return self.signal * np.exp(-gap / 2)
        if self.name != "matern52":
            raise ValueError(f"no such kernel: {self.name}")
        # In place: the matrices are larger than what is done with them.
        gap *= 5
        far = np.sqrt(gap)
        gap /= 3
        gap += far
        gap += 1
        gap *= np.exp(np.negative(far, out=far), out=far)
        gap *= self.signal
        return gap


def lower_inverse(lower: np.ndarray) -> np.ndarray:
    """The inverse of a lower triangle by halves, in about a third of the time of a general inverse."""
    if len(lower) <= 64:
        return np.tril(np.linalg.inv(lower))
    half = len(lower) // 2
    out = np.zeros_like(lower)
    out[:half, :half], out[half:, half:] = lower_inverse(lower[:half, :half]), lower_inverse(lower[half:, half:])
    out[half:, :half] = -out[half:, half:] @ (lower[half:, :half] @ out[:half, :half])
    return out


def _finite(*columns: Column) -> Column:
    every = F.lit(True)
    for c in columns:
        every = every & F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False))
    return every


def _numbered(rows: DataFrame, group: str, key: str, x: list[str], block: int, **more: Column) -> DataFrame:
    """``rows`` with finite ``x`` and ``more``, each with its block r and its place in it, and its group's last block."""
    whole = rows.select(group, key, F.array(*(F.col(c).cast("double") for c in x)).alias("x"), *(c.cast("double").alias(n) for n, c in more.items()), _finite(*(F.col(c) for c in x), *more.values()).alias("whole")).where("whole").drop("whole")
    line = Window.partitionBy(group)
    at = F.row_number().over(line.orderBy(key, "x", *more)) - 1
    whole = whole.withColumn("at", at).withColumn("last", F.floor((F.count("*").over(line) - 1) / block).cast("int"))
    return whole.withColumn("r", F.floor(F.col("at") / block).cast("int")).withColumn("place", F.col("at") % block).drop("at")


def _parts(numbered: DataFrame, group: str, *more: str) -> DataFrame:
    """One row for each block: its rows' values as flat arrays, in the order of their places."""
    rows = F.sort_array(F.collect_list(F.struct("place", "x", *more)))
    parts = numbered.groupBy(group, "r").agg(rows.alias("rows"), F.first("last").alias("last"))
    return parts.select(group, "r", "last", F.flatten("rows.x").alias("x"), *(F.col(f"rows.{n}").alias(n) for n in more))


def _walk(training: DataFrame, group: str, width: int, kernel: Kernel, leave: bool, points: DataFrame | None, block: int) -> DataFrame:
    """What the decomposition leaves of the rows that walk along (group, kind, r, place, sq, dot): the squares of their row of products
    with the inverse factor and its product with the targets'.  Kind e is the unit matrix's row of a training row, kind p a new point.
    """
    spark = training.sparkSession
    schema = f"`{group}` {training.schema[group].dataType.simpleString()}, kind string, r int, k int, m binary, sq array<double>, dot array<double>"
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = keep(_parts(training, group, "y", "noise"), "process-parts")
    fresh = None if points is None else keep(_parts(points, group).drop("last"), "process-points")

    def matrix(values: bytes, columns: int) -> np.ndarray:
        return np.frombuffer(values).reshape(-1, columns)

    def out(row, *made: tuple) -> pd.DataFrame:
        return pd.DataFrame([(row[group], *m) for m in made], columns=[group, "kind", "r", "k", "m", "sq", "dot"])

    def factor(row) -> tuple[np.ndarray, np.ndarray]:
        x, y = np.asarray(row["xk"]).reshape(-1, width), np.asarray(row["y"], dtype=float)
        square = kernel.between(x, x) + np.diag(row["noise"])
        if row["sk"] is not None:
            square, y = square - matrix(row["sk"], len(x)), y - np.frombuffer(row["sy"])
        inverse = lower_inverse(np.linalg.cholesky(square))
        return inverse, inverse @ y

    def head(pdf: pd.DataFrame) -> pd.DataFrame:
        row = pdf.iloc[0]
        k, needed = int(row["k"]), row["k"] < row["last"]
        inverse, z = factor(row)
        made = [("y", 0, k, z.tobytes(), None, None)]
        if k:
            made.append(("h", k, k, inverse.tobytes(), None, None))
        if leave:
            made.append(("e", k, k, np.ascontiguousarray(inverse.T).tobytes() if needed else None, (inverse**2).sum(axis=0), inverse.T @ z))
        return out(row, *made)

    def body(pdf: pd.DataFrame) -> pd.DataFrame:
        row = pdf.iloc[0]
        xk = np.asarray(row["xk"]).reshape(-1, width)
        made = np.zeros((block, len(xk))) if row["kind"] == "e" else kernel.between(np.asarray(row["x"]).reshape(-1, width), xk)
        if row["s"] is not None:
            made = made - matrix(row["s"], len(xk))
        # The first factor needs nothing but its rows, so it is made anew where it is needed instead of being sent.
        inverse, z = (matrix(row["inverse"], len(xk)), np.frombuffer(row["z"])) if row["k"] else factor(row)
        made = made @ inverse.T
        m = made.tobytes() if row["k"] < row["last"] else None
        if row["kind"] == "t":
            return out(row, ("t", row["r"], row["k"], m, None, None))
        return out(row, (row["kind"], row["r"], row["k"], m, (made**2).sum(axis=1), made @ z))

    def multiply(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(matrix(m, block) @ matrix(o, block).T for m, o in zip(pdf["m"], pdf["other"]))
        return pdf.iloc[:1][[group, "kind", "r"]].assign(s=total.tobytes())

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.iloc[:1][[group, "kind", "r"]].assign(s=sum(np.frombuffer(s) for s in pdf["s"]).tobytes())

    def dealt(rows: DataFrame, *keys: str):
        # A number of partitions of its own: rows are few and small, what is done with each is not.
        return rows.repartition(tasks, *keys).groupBy(*keys)

    summed = schema.split(", k int")[0] + ", s binary"
    each, panels, none = [group, "kind", "r"], None, F.lit(None).cast("binary")
    for k in range((parts.agg(F.max("r")).first()[0] or 0) + 1):
        pivot = parts.where(F.col("r") == k).select(group, "last", F.lit(k).alias("k"), F.col("x").alias("xk"), "y", "noise")
        if k:
            # Of rows that are done with, only those of campaigns that have this step are needed.
            across = panels.where((F.col("kind") == "t") & (F.col("r") == k)).select(group, "k", F.col("m").alias("other"))
            pieces = panels.where((F.col("kind").isin("y", "e", "p")) | ((F.col("kind") == "t") & (F.col("r") >= k))).where("m IS NOT NULL").join(across, [group, "k"])
            pieces = pieces.select(*each, "m", "other", F.floor(F.col("k") / SPAN).alias("span"))
            sums = dealt(pieces, *each, "span").applyInPandas(multiply, summed)
            sums = keep(dealt(sums, *each).applyInPandas(add, summed), "process-sums")
            ours = sums.where((F.col("kind") == "t") & (F.col("r") == k)).select(group, F.col("s").alias("sk"))
            pivot = pivot.join(ours, group).join(sums.where("kind = 'y'").select(group, F.col("s").alias("sy")), group)
        else:
            pivot = pivot.withColumn("sk", none).withColumn("sy", none)
        heads = keep(dealt(pivot, group).applyInPandas(head, schema), "process-heads")
        walking = parts.where(F.col("r") > k).select(group, F.lit("t").alias("kind"), "r", "x")
        if leave:
            walking = walking.unionByName(parts.where(F.col("r") < k).select(group, F.lit("e").alias("kind"), "r", F.lit(None).cast("array<double>").alias("x")))
        if points is not None:
            walking = walking.unionByName(fresh.select(group, F.lit("p").alias("kind"), "r", "x"))
        if k:
            known = heads.where("kind = 'h'").select(group, F.col("m").alias("inverse")).join(heads.where("kind = 'y'").select(group, F.col("m").alias("z")), group)
            known = walking.join(pivot.select(group, "last", "k", "xk").join(known, group), group).join(sums, each, "left")
        else:
            known = walking.join(pivot, group).withColumn("s", none)
        below = keep(dealt(known, *each).applyInPandas(body, schema), "process-panels")
        step = heads.where("kind != 'h'").unionByName(below)
        panels = step if panels is None else panels.unionByName(step)
    told = panels.where("sq IS NOT NULL").select(*each, F.posexplode(F.arrays_zip("sq", "dot")).alias("place", "at"))
    return told.groupBy(*each, "place").agg(F.sum("at.sq").alias("sq"), F.sum("at.dot").alias("dot"))


def _noise(noise: float | str) -> Column:
    """A row's noise variance: one for all, or a column whose nulls take 0.01; at least LEAST_NOISE."""
    own = F.coalesce(F.col(noise), F.lit(0.01)) if isinstance(noise, str) else F.lit(noise)
    return F.greatest(own.cast("double"), F.lit(LEAST_NOISE))


def leave_one_out(rows: DataFrame, group: str, key: str, x: list[str], y: str, kernel: Kernel = Kernel(), noise: float | str = 0.01, block: int = BLOCK) -> DataFrame:
    """What a group's other rows say about each of its rows: group, key, y, mu, sigma, residual, weight.

    mu and sigma are those of a process fitted without the row (sigma with the row's noise), by the closed form: with A the inverse of the covariance of all rows,
    the weight of a row is (A y), and it is missed by weight / A's diagonal with variance 1 / A's diagonal.  residual is the miss in sigmas.  Rows whose x, y or noise
    is null or not finite take no part; repeated rows are rows of their own; a group of under three rows has none.
    """
    training = keep(_numbered(rows, group, key, x, block, y=F.col(y), noise=_noise(noise)), "process-rows")
    found = _walk(training, group, len(x), kernel, True, None, block).where("kind = 'e'")
    counts = training.groupBy(group).agg(F.count("*").alias("n")).where("n >= 3").select(group)
    told = training.join(found, [group, "r", "place"]).join(counts, group)
    miss = F.col("dot") / F.col("sq")
    sigma = F.sqrt(F.greatest(1 / F.col("sq"), F.lit(1e-12)))
    return told.select(group, key, "y", (F.col("y") - miss).alias("mu"), sigma.alias("sigma"), (F.abs(miss) / sigma).alias("residual"), F.col("dot").alias("weight"))


def outliers(rows: DataFrame, group: str, key: str, x: list[str], y: str, threshold: float = 3.0, **how) -> DataFrame:
    """The rows that the others of their group miss by more than ``threshold`` sigmas: group, key, mu, sigma, residual."""
    told = leave_one_out(rows, group, key, x, y, **how).where(F.col("residual") > threshold)
    return told.select(group, key, *(tidy(F.col(c), 5).alias(c) for c in ("mu", "sigma", "residual")))


def predict(rows: DataFrame, points: DataFrame, group: str, key: str, point: str, x: list[str], y: str, kernel: Kernel = Kernel("matern52"), noise: float | str = 0.01, block: int = BLOCK) -> DataFrame:
    """Mean and variance at each of ``points`` (group, point, x) under its group's process: group, point, mu, var.

    ``noise`` may be a column: each row then counts by a noise variance of its own.  A group without a row says 0 with the kernel's variance.
    Points with a null or non-finite coordinate have no row.
    """
    training = keep(_numbered(rows, group, key, x, block, y=F.col(y), noise=_noise(noise)), "process-rows")
    asked = keep(_numbered(points, group, point, x, block), "process-asked")
    found = _walk(training, group, len(x), kernel, False, asked, block).where("kind = 'p'").drop("kind")
    told = asked.join(found, [group, "r", "place"], "left")
    var = F.greatest(kernel.signal - F.coalesce("sq", F.lit(0.0)), F.lit(1e-12))
    return told.select(group, point, F.coalesce("dot", F.lit(0.0)).alias("mu"), var.alias("var"))


def noise_impact(rows: DataFrame, group: str, key: str, x: list[str], y: str, noise: str, kernel: Kernel = Kernel("matern52"), block: int = BLOCK) -> DataFrame:
    """How much a row's own noise changes its weight, against the mean noise of its group for all: group, key, own_weight, mean_weight, ratio.

    ``key`` tells a group's rows apart.
    """
    whole = rows.where(_finite(*(F.col(c) for c in (*x, y)), _noise(noise))).select(group, key, *x, y, _noise(noise).alias("own"))
    level = whole.groupBy(group).agg(F.avg("own").alias("level"))
    own = leave_one_out(whole, group, key, x, y, kernel, "own", block).select(group, key, F.abs("weight").alias("own_weight"))
    mean = leave_one_out(whole.join(level, group), group, key, x, y, kernel, "level", block).select(group, key, F.abs("weight").alias("mean_weight"))
    return own.join(mean, [group, key]).withColumn("ratio", F.col("own_weight") / F.greatest("mean_weight", F.lit(1e-30)))


def entropy_changes(rows: DataFrame, group: str, order: str, y: str, window: int = 5) -> DataFrame:
    """Where the variance of ``window`` values in a row changes from one window to the next by over twice the deviation of such changes: group, order, score.

    The place is that of the value that the later window begins to cover.  Variance and deviation are the population's.  Rows with a null value take no part;
    groups of fewer than ``window`` + 2 values or of equal changes have none.
    """
    line = Window.partitionBy(group).orderBy(order)
    span = line.rowsBetween(1 - window, 0)
    held = rows.where(F.col(y).isNotNull()).select(group, order, F.when(F.count("*").over(span) == window, F.var_pop(y).over(span)).alias("spread"))
    change = F.abs(F.col("spread") - F.lag("spread").over(line))
    held = held.withColumn("change", change).where("change IS NOT NULL")
    every = held.groupBy(group).agg(F.stddev_pop("change").alias("usual"))
    told = held.join(every, group).where("usual > 1e-12 AND change > 2 * usual")
    return told.select(group, order, tidy(F.col("change") / F.col("usual"), 5).alias("score"))


def residual_outliers(rows: DataFrame, y: str, mu: str, sigma: str, threshold: float = 3.0) -> DataFrame:
    """The rows whose ``y`` is over ``threshold`` predicted deviations from its prediction, with that residual; a deviation of 0 flags none."""
    told = rows.withColumn("residual", F.when(F.col(sigma) > 0, tidy(F.abs(F.col(y) - F.col(mu)) / F.col(sigma), 5)))
    return told.where(F.col("residual") > threshold)

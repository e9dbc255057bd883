"""Skylines, dominance ranks and quality indicators of objective sets.

All objectives are minimised here; negate what is to be maximised.  A skyline is found in two steps: every partition
reduces its rows to a local skyline first, so only the few survivors meet.  ``group`` columns keep sets apart.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import safe_corr, tidy


def _local(points: np.ndarray) -> np.ndarray:
    """Rows of a batch that no other row dominates."""
    order = np.lexsort(points.T[::-1])
    kept: list[int] = []
    for i in order:
        p = points[i]
        held = points[kept]
        if not len(held) or not ((held <= p).all(axis=1) & (held < p).any(axis=1)).any():
            kept.append(i)
    return np.sort(np.array(kept, dtype=np.int64))


def front(table: DataFrame, objectives: list[str], group: list[str]) -> DataFrame:
    """The rows that no row of their group dominates; equal rows all stay."""

    def thin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = [g.index[_local(g[objectives].to_numpy(dtype=float))] for _, g in pdf.groupby(group, sort=False, dropna=False)]
            yield pdf.loc[np.concatenate(keep)] if keep else pdf

    some = table.mapInPandas(thin, table.schema)
    rivals = some.select(*group, *(F.col(o).alias(f"{o}_") for o in objectives)).distinct()
    no_worse, better = F.lit(True), F.lit(False)
    for o in objectives:
        no_worse = no_worse & (F.col(f"{o}_") <= F.col(o))
        better = better | (F.col(f"{o}_") < F.col(o))
    same = F.lit(True)
    for g in group:
        rivals = rivals.withColumnRenamed(g, f"{g}__")
        same = same & F.col(g).eqNullSafe(F.col(f"{g}__"))
    return some.join(rivals, same & no_worse & better, "left_anti")


def front_2d(table: DataFrame, a: str, b: str, group: list[str]) -> DataFrame:
    """The two-objective skyline by sorting alone: a row stays if it has the least ``b`` of its ``a`` and every smaller
    ``a`` has a larger ``b``."""
    lows = table.groupBy(*group, a).agg(F.min(b).alias(b))
    smaller = Window.partitionBy(*group).orderBy(a).rowsBetween(Window.unboundedPreceding, -1)
    steps = lows.withColumn("prior_", F.min(b).over(smaller)).where(F.col("prior_").isNull() | (F.col(b) < F.col("prior_"))).drop("prior_")
    return table.join(steps, [*group, a, b], "left_semi")


def tradeoffs(table: DataFrame, a: str, b: str, group: list[str]) -> DataFrame:
    """Correlation of two objectives: conflict below -0.3, harmony above 0.3."""
    r = tidy(safe_corr(F.col(a), F.col(b)), 4)
    out = table.groupBy(*group).agg(F.count("*").alias("n"), r.alias("r")).where("n >= 3")
    return out.withColumn("kind", F.when(F.col("r") < -0.3, "conflict").when(F.col("r") > 0.3, "harmony").otherwise("neutral"))


def crowding(table: DataFrame, objectives: list[str], group: list[str], key: str) -> DataFrame:
    """Each row's neighbour gaps over the range, summed over objectives; null for rows at an end."""
    total, ends = F.lit(0.0), F.lit(False)
    rows = table
    for o in objectives:
        line, every = Window.partitionBy(*group).orderBy(o, key), Window.partitionBy(*group)
        span = F.max(o).over(every) - F.min(o).over(every)
        rows = rows.withColumns({f"{o}_gap": F.when(span > 0, (F.lead(o).over(line) - F.lag(o).over(line)) / span).otherwise(0.0), f"{o}_end": F.lag(o).over(line).isNull() | F.lead(o).over(line).isNull()})
        total, ends = total + F.col(f"{o}_gap"), ends | F.col(f"{o}_end")
    return rows.select(*group, key, tidy(F.when(~ends, total)).alias("crowding"))


def hypervolume_2d(table: DataFrame, a: str, b: str, reference: tuple[float, float], group: list[str]) -> DataFrame:
    """The area between each group's skyline and a reference point."""
    inside = table.where((F.col(a) < reference[0]) & (F.col(b) < reference[1])).groupBy(*group, a).agg(F.min(b).alias(b))
    smaller = Window.partitionBy(*group).orderBy(a).rowsBetween(Window.unboundedPreceding, -1)
    steps = inside.withColumn("top", F.coalesce(F.min(b).over(smaller), F.lit(float(reference[1])))).where(F.col(b) < F.col("top"))
    return steps.groupBy(*group).agg(tidy(F.sum((reference[0] - F.col(a)) * (F.col("top") - F.col(b))), 2).alias("hypervolume"))


def knee(table: DataFrame, objectives: list[str], group: list[str], key: str) -> DataFrame:
    """The row nearest to the ideal point in normalised objectives, the smallest key on ties."""
    every = Window.partitionBy(*group)
    d = F.lit(0.0)
    for o in objectives:
        span = F.max(o).over(every) - F.min(o).over(every)
        d = d + F.when(span > 0, ((F.col(o) - F.min(o).over(every)) / span) ** 2).otherwise(0.0)
    rows = table.withColumn("distance", tidy(F.sqrt(d)))
    best = rows.groupBy(*group).agg(F.min(F.struct("distance", key)).alias("best"))
    return best.select(*group, f"best.{key}", "best.distance")


def dominance_rank(table: DataFrame, objectives: list[str], group: list[str]) -> DataFrame:
    """Each row's front number from 1: one more than the highest of those that dominate it; a row with a null or NaN objective has 1.

    A group's distinct points stream in their order, so whoever dominates a point came before it.  A front is known by what its points
    have least of the other objectives: one number for two objectives, for more the skyline over all but the first.  Sorting is the engine's; a task
    holds a batch and that state, and repeated rows never reach it.
    """
    names, keys = [f"o{i}__" for i in range(len(objectives))], [f"g{i}__" for i in range(len(group))]
    whole = F.lit(True)
    for o in objectives:
        whole = whole & F.col(o).isNotNull() & ~F.isnan(F.col(o).cast("double"))
    points = table.where(whole).select(*(F.col(g).alias(k) for g, k in zip(group, keys)), *(F.col(o).cast("double").alias(n) for o, n in zip(objectives, names))).distinct()

    def rank_of(fronts: list[np.ndarray], rest: np.ndarray) -> int:
        # What beats a point in one front is itself beaten in every front before.
        low, high = 0, len(fronts)
        while low < high:
            middle = (low + high) // 2
            low, high = (middle + 1, high) if (fronts[middle] <= rest).all(axis=1).any() else (low, middle)
        return low

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, fronts = object(), []
        for pdf in batches:
            ranks = []
            held = zip(*(pdf[k] for k in keys)) if keys else ((),) * len(pdf)
            for own, rest in zip(held, pdf[names[1:]].to_numpy(dtype=float)):
                own = tuple(None if pd.isna(v) else v for v in own)
                if own != at:
                    at, fronts = own, []
                if len(rest) == 1:
                    n = bisect_right(fronts, rest[0])
                    fronts[n : n + 1] = [rest[0]]
                else:
                    n = rank_of(fronts, rest)
                    kept = fronts[n] if n < len(fronts) else np.empty((0, len(rest)))
                    fronts[n : n + 1] = [np.vstack([kept[~(rest <= kept).all(axis=1)], rest])]
                ranks.append(n + 1)
            yield pdf.assign(rank__=ranks)

    dealt = points.repartition(*map(F.col, keys)) if keys else points.coalesce(1)
    ranked = dealt.sortWithinPartitions(*keys, *names).mapInPandas(stream, T.StructType([*points.schema.fields, T.StructField("rank__", T.LongType())]))
    same = F.lit(True)
    for c, k in [*((F.col(g), k) for g, k in zip(group, keys)), *((F.col(o).cast("double"), n) for o, n in zip(objectives, names))]:
        same = same & c.eqNullSafe(F.col(k))
    return table.join(ranked, same, "left").select(*table.columns, F.coalesce("rank__", F.lit(1).cast("long")).alias("dominance_rank"))

"""The nearest trials of a campaign, block by block in Arrow batches: pairs of trials are numbers in a matrix, never rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 1024
CELLS = 1 << 18


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """Halves up, as the engine's ``round`` does it on a number's shortest decimal form."""
    scale = 10.0**digits
    whole = np.floor(x * scale + 0.5)
    for i in np.flatnonzero(np.isfinite(x) & (np.abs(x * scale + 0.5 - np.round(x * scale + 0.5)) < 1e-3)):
        whole.flat[i] = float(Decimal(repr(float(x.flat[i]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP).scaleb(digits))
    return whole / scale


def _blocks(rows: DataFrame, key: str, x: list[Column], y: Column, block: int, tag: str) -> DataFrame:
    """One row for each campaign and block of about ``block`` rows: their keys, coordinates and values as flat arrays, by key."""
    flat = rows.select("campaign_id", F.col(key).cast("long").alias("key"), F.array(*(c.cast("double") for c in x)).alias("x"), y.cast("double").alias("y"))
    sizes = flat.groupBy("campaign_id").agg(F.count("*").alias("n"))
    part = F.pmod(F.xxhash64("campaign_id", "key"), F.ceil(F.col("n") / block))
    held = flat.join(sizes, "campaign_id").groupBy("campaign_id", part.alias("part")).agg(F.sort_array(F.collect_list(F.struct("key", "x", "y"))).alias("rows"))
    return held.select("campaign_id", F.col("rows.key").alias(f"{tag}_key"), F.flatten("rows.x").alias(f"{tag}_x"), F.col("rows.y").alias(f"{tag}_y"))


def nearest(asked: DataFrame, known: DataFrame, ask: str, key: str, x: list[Column], y: Column, measure: Callable[[np.ndarray, np.ndarray], np.ndarray], k: int, block: int = BLOCK) -> DataFrame:
    """campaign_id, ``ask`` and near: for each row of ``asked`` the ``k`` of ``known`` in its campaign of least distance, as structs d, key, y in order, ties to the lesser key.

    ``measure`` gives the distances of two sets of coordinates as a matrix; unknown ones count as infinite, and y is NaN where it is null.  Both sides are
    dealt into blocks; every two blocks of a campaign meet in one task, and ``k`` of each known block leave it.  Keys are unique in a campaign.
    """
    width = len(x)
    left, right = _blocks(asked, ask, x, F.lit(None), block, "a").drop("a_y"), _blocks(known, key, x, y, block, "b")
    none = {c: F.coalesce(c, F.array().cast("array<double>" if c != "b_key" else "array<bigint>")) for c in ("b_key", "b_x", "b_y")}
    pairs = left.join(right, "campaign_id", "left").withColumns(none)

    def lists(column: pa.Array) -> Iterator[np.ndarray]:
        for i in range(len(column)):
            yield column[i].values.to_numpy(zero_copy_only=False)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = {n: batch.column(n) for n in batch.schema.names}
            for i, (a_key, a_x, b_key, b_x, b_y) in enumerate(zip(*(lists(c[n]) for n in ("a_key", "a_x", "b_key", "b_x", "b_y")))):
                a, b = a_x.reshape(-1, width).astype(float), b_x.reshape(-1, width).astype(float)
                step = max(1, CELLS // max(1, len(b)))
                for at in range(0, len(a), step):
                    some = a[at : at + step]
                    if len(b):
                        d = measure(some, b)
                        d = np.where(np.isnan(d), np.inf, d)
                        limit = np.partition(d, k - 1, axis=1)[:, k - 1 : k] if len(b) > k else np.full((len(some), 1), np.inf)
                        row, col = np.nonzero(d <= limit)
                        order = np.lexsort((col, d[row, col], row))
                        row, col = row[order], col[order]
                        first = np.searchsorted(row, np.arange(len(some)))
                        kept = np.arange(len(row)) - first[row] < k
                        row, col = row[kept], col[kept]
                        found = d[row, col]
                    else:
                        row = col = np.empty(0, dtype=int)
                        found = np.empty(0)
                    ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(some)))]).astype(np.int32))
                    each = [pa.ListArray.from_arrays(ends, pa.array(v)) for v in (found, b_key[col].astype(np.int64), b_y[col].astype(float))]
                    yield pa.RecordBatch.from_arrays([pa.array([c["campaign_id"][i].as_py()] * len(some), batch.schema.field("campaign_id").type), pa.array(a_key[at : at + step].astype(np.int64)), *each], ["campaign_id", ask, "d", "key", "y"])

    told = pairs.mapInArrow(meet, f"campaign_id {asked.schema['campaign_id'].dataType.simpleString()}, `{ask}` bigint, d array<double>, key array<bigint>, y array<double>")
    told = told.select("campaign_id", ask, F.arrays_zip("d", "key", "y").alias("near"))
    return told.groupBy("campaign_id", ask).agg(F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, k).alias("near"))

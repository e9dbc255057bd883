"""Joins on keys of which a few may hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_PARTS = 1000


def join_skewed(left: DataFrame, right: DataFrame, key: str, rows: str, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right``, which has one row per key and says in column ``rows`` how many rows of ``left`` have it.

    A key with more than one in HOT_PARTS of all rows is hot; there are fewer than HOT_PARTS such keys whatever the data, so
    their rows of ``right`` are sent to every executor and their rows of ``left`` stay where they are.  All others are
    joined by a shuffle in which no key is large.  Both sides should be tables or cheap to compute twice.
    """
    total = right.agg(F.sum(rows)).first()[0] or 0
    least = total // HOT_PARTS + 1
    hot = F.broadcast(right.where(F.col(rows) >= least).drop(rows))
    rest = left.join(hot.select(key), key, "left_anti").join(right.where(F.col(rows) < least).drop(rows), key, how)
    return left.join(hot, key).unionByName(rest)

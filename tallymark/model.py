"""The campaign model and how plain tables map onto it.

Observations have one row per trial: campaign_id, iteration (0-based position in the campaign), parameters as columns
``p_*``, the primary objective ``kpi``, and ``is_failure``.  The mapped tables keep these names, so an operator runs
on any of them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Spec:
    """A numeric parameter and its bounds."""

    name: str
    lower: float
    upper: float


LINE_SPECS = (Spec("p_quantity", 1.0, 50.0), Spec("p_discount", 0.0, 0.1), Spec("p_tax", 0.0, 0.08))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# Rows of one task where a table is dealt by campaign.
TASK_ROWS = 500_000


def dealt(table: DataFrame, key: str) -> DataFrame:
    """``table`` hashed by ``key`` over more tasks than the session's where these would hold over TASK_ROWS rows each."""
    tasks = -(-table.count() // TASK_ROWS)
    return table.repartition(tasks, key) if tasks > int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")) else table


def line_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier's line items as a campaign: price is the objective, returned items are failures."""
    order = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    lines = dealt(read(spark, sf_dir, "lineitem"), "l_suppkey")
    return lines.select(
        F.col("l_suppkey").alias("campaign_id"),
        (F.row_number().over(order) - 1).cast("long").alias("iteration"),
        F.col("l_quantity").alias("p_quantity"),
        F.col("l_discount").alias("p_discount"),
        F.col("l_tax").alias("p_tax"),
        F.col("l_extendedprice").alias("kpi"),
        (F.col("l_returnflag") == "R").alias("is_failure"),
        F.col("l_linestatus").alias("m_status"),
    )


def event_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events in time order as a campaign: error events are failures."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    events = dealt(read(spark, sf_dir, "events"), "user_id")
    return events.select(
        F.col("user_id").alias("campaign_id"),
        (F.row_number().over(order) - 1).cast("long").alias("iteration"),
        "event_id",
        "ts",
        "event_type",
        F.col("value").alias("kpi"),
        (F.col("event_type") == "error").alias("is_failure"),
    )


LINE_SQL = """obs AS (
  SELECT l_suppkey AS campaign_id,
         row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS iteration,
         l_quantity AS p_quantity, l_discount AS p_discount, l_tax AS p_tax, l_extendedprice AS kpi,
         l_returnflag = 'R' AS is_failure, l_linestatus AS m_status
  FROM lineitem)"""

EVENT_SQL = """obs AS (
  SELECT user_id AS campaign_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS iteration,
         event_id, ts, event_type, value AS kpi, event_type = 'error' AS is_failure
  FROM events)"""

"""Streams of trial events: windowed health, retries with state, and the suggest-measure-learn loop.

Sources are folders of Parquet event files (event_id, ts, user_id, event_type, value); every stream states its watermark or a
time to live, so state stays bounded by the lateness allowed or by the campaigns of that time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double"


def event_stream(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def windowed_health(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Rows, failures, mean and best value of each event window."""
    windows = events.withWatermark("ts", late).groupBy(F.window("ts", width))
    out = windows.agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("n_failed"), F.avg("value").alias("mean_value"), F.max("value").alias("best_value"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", "n_failed", "mean_value", "best_value")


def once_only(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Each event id once, however often it is delivered within the lateness allowed."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def retries(events: DataFrame, most: int = 3, late: str = "400 days", forget: str = "7 days") -> DataFrame:
    """Per campaign, the consecutive failures so far and whether the campaign is abandoned after ``most`` of them.

    A campaign without events is forgotten once the watermark, ``late`` behind the newest event, is ``forget`` beyond its last one, so
    the state holds the campaigns of that time only; if it comes back, it starts anew.  Of a campaign's events in one batch the
    times, ids and kinds alone are brought together.
    """
    ttl = int(pd.Timedelta(forget).total_seconds() * 1000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        failed, abandoned = state.get if state.exists else (0, False)
        seen = 0
        rows = pd.concat(list(batches)).sort_values(["at", "event_id"])
        for kind in rows["event_type"]:
            failed = failed + 1 if kind == "error" else 0
            abandoned = abandoned or failed >= most
            seen += 1
        state.update((failed, abandoned))
        state.setTimeoutTimestamp(int(rows["at"].max()) + ttl)
        yield pd.DataFrame({"user_id": [key[0]], "n_new": [seen], "failures_in_a_row": [failed], "abandoned": [abandoned]})

    narrow = events.where("ts IS NOT NULL").withWatermark("ts", late).select("user_id", "ts", F.unix_millis("ts").alias("at"), "event_id", "event_type")
    return narrow.groupBy("user_id").applyInPandasWithState(step, "user_id long, n_new long, failures_in_a_row long, abandoned boolean", "failed long, abandoned boolean", "update", GroupStateTimeout.EventTimeTimeout)


def closed_loop(events: DataFrame, suggest: Callable[[DataFrame], DataFrame], observations: str, suggestions: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch of results is appended to the observations, and every campaign it touches gets new suggestions.

    Both tables are written under the batch's number, so a batch that is run again after a failure replaces its own output.
    """

    def learn(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{observations}/batch={number}")
        touched = spark.read.parquet(f"{observations}/batch={number}").select("user_id").distinct()
        known = spark.read.parquet(observations).where(F.col("batch") <= number)
        suggest(known.join(touched, "user_id", "left_semi").drop("batch")).write.mode("overwrite").parquet(f"{suggestions}/batch={number}")

    return events.writeStream.foreachBatch(learn).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Evidence for and against hypotheses as it arrives.

The state of a group and hypothesis is four numbers, however many rows have come, and a timer drops it once the
watermark is beyond the group's last event by the time to live: the state holds the groups of that time only.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.equations import Tree
from ..operators.evidence import verdicts

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTPUT = "user_id long, hypothesis string, n_evidence long, n_supporting long, refuted_in_a_row long, falsified boolean"


class Tally(StatefulProcessor):
    """Counts evidence; says how a hypothesis stands after each batch that brings some."""

    def __init__(self, falsified_by: int, forget_ms: int):
        self.falsified_by, self.forget_ms = falsified_by, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.standing = handle.getValueState("standing", "n long, supporting long, streak long, timer long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, supporting, streak, timer = self.standing.get() if self.standing.exists() else (0, 0, 0, 0)
        # Order matters only between the chunks of one batch: what comes after the last supporting row is the streak.
        parts = [r[["at", "event_id", "supports"]] for r in rows]
        batch = pd.concat(parts).sort_values(["at", "event_id"], kind="stable")
        good = batch["supports"].to_numpy(dtype=bool)
        hits = good.nonzero()[0]
        n, supporting = n + len(good), supporting + len(hits)
        streak = streak + len(good) if not len(hits) else len(good) - 1 - int(hits[-1])
        due = max(timer, int(batch["at"].max()) + self.forget_ms)
        if due != timer:
            if timer:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
        self.standing.update((n, supporting, streak, due))
        yield pd.DataFrame({"user_id": [key[0]], "hypothesis": [key[1]], "n_evidence": [n], "n_supporting": [supporting], "refuted_in_a_row": [streak], "falsified": [streak >= self.falsified_by]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.standing.clear()
        return iter(())

    def close(self) -> None:
        pass


def watch(events: DataFrame, hypotheses: dict[str, Tree], band: float = 1.0, falsified_by: int = 3, late: str = "10 minutes", forget: str = "7 days") -> DataFrame:
    """How each user's hypotheses on the value of their events stand, after each batch that brings evidence.

    Events (event_id, ts, user_id, event_type, value) without a time or a user are left out: the grouped processor of Spark 4.1 mixes a null
    key with another.  Those of one batch are taken in the order of time and id;
    batches, as they come.  A user who comes back after ``forget`` starts anew.  The session's state store must be ``STORE``.
    """
    known = events.where("ts IS NOT NULL AND user_id IS NOT NULL").withWatermark("ts", late).withColumn("at", F.unix_millis("ts"))
    found = verdicts(known, hypotheses, "value", ["user_id", "ts", "at", "event_id"], band)
    tally = Tally(falsified_by, int(pd.Timedelta(forget).total_seconds() * 1000))
    return found.groupBy("user_id", "hypothesis").transformWithStateInPandas(statefulProcessor=tally, outputStructType=OUTPUT, outputMode="Update", timeMode="EventTime")

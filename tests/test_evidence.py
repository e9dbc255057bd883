"""Evidence in batches and as it arrives."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from tallymark.operators import evidence
from tallymark.streaming import loop
from tallymark.streaming import evidence as stream

EVENTS = loop.EVENTS.replace("ts timestamp", "t long")
HYPOTHESES = {"flat": ("const", 5.0), "sum": ("+", ("var", "event_id"), ("const", 1.0)), "none": ("log", ("const", 0.0))}


def events(spark):
    rows = [(i, 1_600_000_000 + 60 * i, i % 3 if i % 7 else None, "x", [5.0, 5.5, 9.0, i + 1.0, -3.0][i * i % 5]) for i in range(120)]
    rows += [(500, 1_600_009_000, 9, "x", None), (501, 1_600_009_000, 9, "x", math.nan)]
    made = spark.createDataFrame(rows, EVENTS)
    return made.select("event_id", F.timestamp_seconds("t").alias("ts"), "user_id", "event_type", "value"), rows


def replay(rows):
    out = {}
    for i, _, user, _, v in sorted(rows, key=lambda r: (r[1], r[0])):
        if v is not None and math.isfinite(v):
            for name, p in (("flat", 5.0), ("sum", i + 1.0), ("none", math.inf)):
                n, good, streak = out.get((user, name), (0, 0, 0))
                fits = abs(v - p) <= 1
                out[user, name] = (n + 1, good + fits, 0 if fits else streak + 1)
    return out


def test_tally_is_a_replay(spark):
    made, rows = events(spark)
    found = evidence.tally(evidence.verdicts(made.repartition(4), HYPOTHESES, "value", ["user_id", "event_id"]), "user_id", "event_id")
    got = {(r.user_id, r.hypothesis): (r.n_evidence, r.n_supporting, r.refuted_in_a_row) for r in found.collect()}
    assert got == replay(rows)
    assert all(r.falsified == (r.refuted_in_a_row >= 3) for r in found.collect())
    assert evidence.tally(evidence.verdicts(made.where("event_id < 0"), HYPOTHESES, "value", ["user_id", "event_id"]), "user_id", "event_id").count() == 0


@pytest.mark.parametrize("files", [1, 4])
def test_stream_ends_like_the_replay(spark, tmp_path, files):
    made, rows = events(spark)
    for k, lo in enumerate(range(0, 120, 30)):
        made.where(f"event_id >= {lo} AND event_id < {lo + 30}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    # Nobody's next event tells that an old one may go, but a much later event does.
    late = spark.createDataFrame([(900, 1_700_000_000, 77, "x", 5.0)], EVENTS).select("event_id", F.timestamp_seconds("t").alias("ts"), "user_id", "event_type", "value")
    late.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    kept = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stream.STORE)
    try:
        watched = stream.watch(loop.event_stream(spark, str(tmp_path / "in"), files), HYPOTHESES)
        name = f"standing{files}"
        q = watched.writeStream.outputMode("update").format("memory").queryName(name).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
        q.awaitTermination()
        left = sum(p["numRowsTotal"] for p in q.lastProgress["stateOperators"])
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", kept)
    last = {}
    for r in spark.table(name).collect():
        at = r.user_id, r.hypothesis
        last[at] = max(last.get(at, (0, 0, 0)), (r.n_evidence, r.n_supporting, r.refuted_in_a_row))
    assert last == {k: v for k, v in replay(rows).items() if k[0] is not None} | {(77, "flat"): (1, 1, 0), (77, "sum"): (1, 0, 1), (77, "none"): (1, 0, 1)}
    # All but the newest user's standings have been dropped (a value and its timers count as rows).
    assert left <= 3 * 4

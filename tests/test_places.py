"""Places, ranks and rank correlations without pairs or whole groups, against plain Python."""

from __future__ import annotations

import random
import statistics

import pytest
from pyspark.sql import functions as F

from tallymark import model
from tallymark.operators import compare, manage, prefer, windows
from tallymark.sources import tables


def sign(v):
    return (v > 0) - (v < 0)


def test_kendall_counts_all_pairs(spark):
    rng = random.Random(4)
    groups = {"ties": [(rng.randrange(4), rng.randrange(3)) for _ in range(60)], "none": [(rng.random(), rng.random()) for _ in range(50)], "one": [(1, 2)], "two": [(1, 2), (2, 1)],
              "alike": [(1, 1)] * 5, "gaps": [(None if rng.random() < 0.3 else rng.randrange(9), None if rng.random() < 0.3 else rng.randrange(9)) for _ in range(40)], "void": [(None, 1), (2, None), (3, 3)]}
    rows = [(g, i, None if a is None else float(a), None if b is None else float(b), 7) for g, v in groups.items() for i, (a, b) in enumerate(v)] + [(None, 1, 1.0, 1.0, 7), (None, 2, 2.0, 2.0, 7)]
    got = {r.g: (r.n_pairs, r.tau) for r in compare.kendall(spark.createDataFrame(rows, "g string, item int, a double, b double, x int"), "item", "a", "b", "g").collect()}
    assert set(got) == set(groups) - {"one"}
    for g, v in groups.items():
        known = [p for p in v if None not in p]
        pairs = len(v) * (len(v) - 1) // 2
        if pairs:
            score = sum(sign(p[0] - q[0]) * sign(p[1] - q[1]) for i, p in enumerate(known) for q in known[:i])
            assert got[g] == (pairs, pytest.approx(score / pairs, abs=1e-6) if len(known) > 1 else None)


def test_numbered(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice([None, 1.0, 2.0, rng.random()]), 0) for i in range(500)]
    table = spark.createDataFrame(rows, "id int, v double, range_id int")
    got = windows.numbered(table, F.col("v").desc_nulls_last(), F.col("id").asc()).collect()
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert [r.id for r in sorted(got, key=lambda r: r.place)] == [r[0] for r in want] and sorted(r.place for r in got) == list(range(1, 501))
    assert windows.numbered(table.where("false"), F.col("id")).count() == 0
    assert sorted(r.place for r in windows.numbered(table.select(F.lit(1).alias("same")), F.col("same")).collect()) == list(range(1, 501))


@pytest.mark.parametrize("maximize", [True, False])
def test_campaign_places(spark, maximize):
    rows = [(1, "a", 3.0), (1, "b", 9.0), (2, "a", 5.0), (3, "c", 5.0), (4, "b", None), (5, "a", 9.0)]
    got = {r.campaign_id: r.place for r in manage.compare_campaigns(spark.createDataFrame(rows, "campaign_id int, kind string, kpi double"), "kind", ["a", "b"], maximize).collect()}
    assert got == ({1: 1, 5: 2, 2: 3, 3: 4, 4: 5} if maximize else {1: 1, 2: 2, 5: 3, 3: 4, 4: 5})


def test_the_front_alone_decides_the_volume(spark):
    rng = random.Random(2)
    rows = [("g", *(rng.random() for _ in range(3)), 1) for _ in range(300)] + [("h", 0.5, 0.5, 0.5, 1)] * 3 + [("h", 2.0, 0.1, 0.1, 1), ("h", None, 0.0, 0.0, 1), ("i", 5.0, 5.0, 5.0, 1)]
    table = spark.createDataFrame(rows, "g string, a double, b double, c double, x int")
    got = {r.g: r for r in prefer.hypervolume_sampled(table, ["a", "b", "c"], [1.0, 1.0, 1.0], "g", 400).collect()}
    assert set(got) == {"g", "h"} and got["h"].n_inside == 400 and got["h"].hypervolume == 0.125
    points = [r[1:4] for r in rows if r[0] == "g"]
    low = [min(p[i] for p in points) for i in range(3)]
    draws = spark.range(400).select(*((F.lit(low[i]) + prefer.unit(F.lit("g"), F.col("id"), F.lit(i)) * (1.0 - low[i])).alias(f"u{i}") for i in range(3))).collect()
    assert got["g"].n_inside == sum(any(all(p[i] <= d[i] for i in range(3)) for p in points) for d in draws)


def test_top_k_stability(spark):
    rng = random.Random(3)
    rows = [("g" if i < 30 else None, f"n{i}", rng.gauss(0, 1), 1) for i in range(45)] + [("solo", "s", 1.0, 1)]
    got = {r.name: r for r in prefer.top_k_stability(spark.createDataFrame(rows, "g string, name string, v double, noise int"), "g", "name", "v", 5, 40).collect()}
    assert len(got) == len(rows) and (got["s"].in_top, got["s"].frequency, got["s"].first_frequency) == (True, 1.0, 1.0)
    for group in ("g", None):
        held = [r for r in rows if r[0] == group]
        noise = statistics.stdev(r[2] for r in held) / len(held) ** 0.5
        best = {r[1] for r in sorted(held, key=lambda r: -r[2])[:5]}
        assert {r[1] for r in held if got[r[1]].in_top} == best
        assert sum(got[r[1]].frequency for r in held) == pytest.approx(5) and sum(got[r[1]].first_frequency for r in held) == pytest.approx(1)
        assert all(got[r[1]].frequency == 0 for r in held if r[2] < min(x[2] for x in held if x[1] in best) - 8 * noise)


def test_top_k_stability_draws_only_what_can_rise(spark, monkeypatch):
    """The draws ordered follow the items near the top, and all that are left out have none; the same in small tasks."""
    values = [("g", f"n{i}", float(i)) for i in range(3000)] + [("g", "none", None), ("few", "a", 2.0), ("few", "b", None), ("odd", "x", float("nan")), ("odd", "y", 1.0)]
    table = spark.createDataFrame(values, "g string, name string, v double")
    sizes = []
    for most in (prefer.TASK_ROWS, 1000):
        monkeypatch.setattr(prefer, "TASK_ROWS", most)
        written = []
        monkeypatch.setattr(prefer, "keep", lambda t, what: written.append((what, tables.keep(t, what))) or written[-1][1])
        told = {r.name: r for r in prefer.top_k_stability(table, "g", "name", "v", 5, 40).collect()}
        sizes.append({(r.name, r.in_top, r.frequency, r.first_frequency) for r in told.values()})
        assert dict(written)["near-highest"].count() < 600
    assert sizes[0] == sizes[1] and len(told) == len(values)
    noise = statistics.stdev(range(3000)) / 3001**0.5
    gauss = lambda c: "sqrt(-2 * ln({0})) * cos(2 * pi() * {1})".format(*(f"(cast(conv(substring(md5(concat_ws(':', name, draw, '{x}')), 1, 13), 16, 10) AS double) + 0.5) / 4503599627370496D" for x in c))
    table.where("g = 'g'").selectExpr("name", "v", "explode(sequence(1, 40)) AS draw").createOrReplaceTempView("drawn")
    plain = spark.sql(f"SELECT name, count(*) AS n FROM (SELECT name, row_number() OVER (PARTITION BY draw ORDER BY v + {noise!r} * {gauss('ab')} DESC, name) AS place FROM drawn) WHERE place <= 5 GROUP BY 1")
    assert {r.name: r.n / 40 for r in plain.collect()} == {n: pytest.approx(r.frequency) for n, r in told.items() if r.g == "g" and r.frequency}
    assert [told[n].frequency for n in ("a", "b", "x", "y", "none")] == [1.0, 1.0, 1.0, 1.0, 0.0]


def test_no_resample_goes_through_the_driver(spark):
    rows = spark.range(2000).select((F.col("id") % 2).cast("int").alias("g"), F.col("id").alias("k"), F.col("id").cast("double").alias("x"), (F.col("id") * 2.0).alias("y"))
    told = prefer.correlation_interval(rows, "g", "k", "x", "y")
    picks = [n for n in told._jdf.queryExecution().executedPlan().toString().split("\n") if "[g" in n and "at" in n and "Join" in n]
    assert picks and all("SortMergeJoin" in n for n in picks)
    assert [(r.g, r.r, r.low, r.high) for r in told.orderBy("g").collect()] == [(0, 1.0, 1.0, 1.0), (1, 1.0, 1.0, 1.0)]


def test_tables_by_campaign_use_more_tasks_when_they_are_large(spark, monkeypatch):
    whole = model.line_observations(spark, "/root/testdata/sf0.001")
    monkeypatch.setattr(model, "TASK_ROWS", 500)
    told = model.line_observations(spark, "/root/testdata/sf0.001")
    assert told.rdd.getNumPartitions() == -(-whole.count() // 500)
    assert told.exceptAll(whole).count() == whole.exceptAll(told).count() == 0

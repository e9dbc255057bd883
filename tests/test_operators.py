"""Operators against hand-made cases, and every catalogue query against its SQL."""

from __future__ import annotations

import glob
import math
import os
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymark.functions import numeric
from tallymark.model import Spec
from tallymark.operators import diagnostics, graph, kernels, pareto, stats, store, windows
from tallymark.plans import catalogue, further, rules, space  # noqa: F401
from tallymark.sources import tables
from tallymark.streaming import loop

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(rows):
    fix = lambda v: None if isinstance(v, float) and math.isnan(v) else round(v, 3) + 0.0 if isinstance(v, float) else v
    return sorted((tuple(fix(v) for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_matches_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = duck.sql(f"SELECT {', '.join(columns)} FROM ({catalogue.ORACLES[name]})")
    assert plain(got.select(*columns).collect()) == plain(want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_query_is_repeatable(spark, name):
    first = plain(catalogue.QUERIES[name](spark, SF).collect())
    assert first == plain(catalogue.QUERIES[name](spark, SF).collect()) and first


def campaign(spark, values, failures=()):
    rows = [(1, i, float(i), v, i in failures, "m") for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "campaign_id long, iteration long, p_x double, kpi double, is_failure boolean, m_status string")


def test_diagnostics_of_simple_campaigns(spark):
    spec = (Spec("p_x", 0.0, 10.0),)
    one = lambda df: diagnostics.diagnostics(df, spec).first()
    flat = one(campaign(spark, [2.0] * 8))
    assert (flat.kpi_plateau_length, flat.variance_contraction, flat.signal_to_noise_ratio) == (7.0, 1.0, 100.0)
    climb = one(campaign(spark, [float(i) for i in range(8)], failures=(7,)))
    assert climb.best_kpi_value == 6.0 and climb.kpi_plateau_length == 0.0 and climb.convergence_trend == 1.0
    assert climb.failure_clustering == 4.0 and climb.feasibility_shrinkage == -0.5
    lost = one(campaign(spark, [1.0, 2.0], failures=(0, 1)))
    assert lost.failure_rate == 1.0 and lost.best_kpi_value == 0.0 and lost.exploration_coverage == 0.0
    assert diagnostics.diagnostics(campaign(spark, [1.0]).limit(0), spec).count() == 0


def test_windows_on_small_series(spark):
    jump = campaign(spark, [0.0] * 6 + [9.0] * 6)
    assert windows.regime_change(jump).first().split_at == 6
    wave = campaign(spark, [math.sin(2 * math.pi * i / 4) for i in range(40)])
    assert windows.season(wave, range(3, 8)).first().period == 4
    assert [r.best for r in windows.best_so_far(campaign(spark, [3.0, 5.0, 4.0], failures=(1,))).orderBy("iteration").collect()] == [3.0, 3.0, 4.0]


@pytest.mark.parametrize("d", [2, 3])
def test_front_against_all_pairs(spark, d):
    points = np.random.default_rng(d).integers(0, 8, (200, d))
    rows = [(i % 3, i, *map(int, p)) for i, p in enumerate(points)]
    names = [f"o{i}" for i in range(d)]
    table = spark.createDataFrame(rows, ["g", "k", *names]).repartition(5)
    beaten = lambda a: any(b[0] == a[0] and all(x <= y for x, y in zip(b[2:], a[2:])) and b[2:] != a[2:] for b in rows)
    want = {r[1] for r in rows if not beaten(r)}
    assert {r.k for r in pareto.front(table, names, ["g"]).collect()} == want
    assert {r.k for r in pareto.dominance_rank(table, names, ["g"]).where("dominance_rank = 1").collect()} == want
    if d == 2:
        assert {r.k for r in pareto.front_2d(table, *names, ["g"]).collect()} == want


@pytest.mark.parametrize("d", [1, 2, 3])
def test_dominance_ranks_are_longest_chains(spark, d):
    points = np.random.default_rng(d).integers(0, 6, (150, d))
    rows = [((i % 3) or None, i, *map(float, p)) for i, p in enumerate(points)] + [(1, 200, None, *[0.0] * (d - 1)), (1, 201, math.nan, *[0.0] * (d - 1))]
    names = [f"o{i}" for i in range(d)]
    got = {r.k: r.dominance_rank for r in pareto.dominance_rank(spark.createDataFrame(rows, f"g int, k int, {', '.join(n + ' double' for n in names)}").repartition(5), names, ["g"]).collect()}
    want: dict[int, int] = {}
    for row in sorted(rows[:-2], key=lambda r: r[2:]):
        want[row[1]] = 1 + max((want[o[1]] for o in rows[:-2] if o[0] == row[0] and o[2:] != row[2:] and all(x <= y for x, y in zip(o[2:], row[2:]))), default=0)
    assert got == want | {200: 1, 201: 1}


def test_dominance_ranks_of_many_rows(spark):
    # A chain of 10,000 points, each nine times: peeling front by front takes minutes.
    table = spark.range(90000).select((F.col("id") % 10000).alias("a"), (F.col("id") % 10000 + 0.5).alias("b"), F.lit("g").alias("g"))
    began = time.monotonic()
    told = pareto.dominance_rank(table, ["a", "b"], ["g"]).agg(F.count("*").alias("n"), F.sum("dominance_rank").alias("s"), F.max(F.abs(F.col("dominance_rank") - F.col("a") - 1)).alias("off")).first()
    assert (told.n, told.off) == (90000, 0) and time.monotonic() - began < 60


def test_closure_with_a_cycle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "parent string, child string")
    got = {(r.ancestor, r.node): r.depth for r in graph.descendants(edges, 6).collect()}
    assert got["a", "d"] == 3 and got["a", "a"] == 3 and ("d", "a") not in got
    score = graph.edge_scores(edges, edges.where("parent <> 'c'").unionByName(spark.createDataFrame([("x", "y")], edges.schema))).first()
    assert (score.n_hit, score.precision, score.recall) == (2, 0.5, round(2 / 3, 6))


def test_acquisitions(spark):
    row = spark.range(1).select(
        *(numeric.norm_cdf(F.lit(x)).alias(f"c{i}") for i, x in enumerate((-2.0, 0.0, 1.5))),
        numeric.expected_improvement(F.lit(1.0), F.lit(0.5), F.lit(1.2)).alias("ei"),
        numeric.expected_improvement(F.lit(1.0), F.lit(0.0), F.lit(1.2)).alias("ei0"),
        numeric.binary_entropy(F.lit(0.5)).alias("h"),
        numeric.log_expected_improvement_per_cost(F.lit(0.0), F.lit(1.0)).alias("l"),
    ).first()
    phi = lambda x: 0.5 * (1 + math.erf(x / math.sqrt(2)))
    assert [row.c0, row.c1, row.c2] == pytest.approx([phi(-2), 0.5, phi(1.5)], abs=1e-7)
    assert row.ei == pytest.approx(0.2 * phi(0.4) + 0.5 * math.exp(-0.08) / math.sqrt(2 * math.pi), abs=1e-6)
    assert (row.ei0, row.h, row.l) == (pytest.approx(0.2), 1.0, float("-inf"))


def test_kernels_keep_bounds(spark):
    obs = catalogue.line_observations(spark, SF)
    for f in (kernels.suggest_gp, kernels.suggest_tpe, kernels.suggest_evolution, kernels.suggest_covariance, lambda o, s: kernels.random_points(o, s, 4), lambda o, s: kernels.halton(o, s, 4)):
        rows = f(obs, catalogue.LINE_SPECS).collect()
        assert rows and all(s.lower <= r[s.name] <= s.upper for r in rows for s in catalogue.LINE_SPECS)
    points = kernels.latin_hypercube(obs, catalogue.LINE_SPECS, 8)
    bins = points.groupBy("campaign_id").agg(F.countDistinct(F.floor((F.col("p_quantity") - 1) / 49 * 8)).alias("n")).collect()
    assert {r.n for r in bins} == {8}
    jump = campaign(spark, [0.0 + 0.01 * (i % 3) for i in range(30)] + [5.0 + 0.01 * (i % 3) for i in range(30)])
    assert any(30 <= r.iteration <= 33 for r in kernels.change_points(jump).collect())
    ci = kernels.bootstrap_mean(campaign(spark, [float(i % 10) for i in range(200)])).first()
    assert ci.low < 4.5 < ci.high and ci.high - ci.low < 2


def test_gp_counts_all_successes(spark):
    rng = np.random.default_rng(3)
    specs = catalogue.LINE_SPECS
    x = rng.random((600, len(specs)))
    y = 5 * np.exp(-((x[:, 0] - 0.3) ** 2) / 0.1) + x[:, 1] + 0.01 * rng.standard_normal(600)
    y[:200] += 30 * np.exp(-((x[:200] - 0.7) ** 2).sum(axis=1) / 0.05)
    rows = [(1, i, float(v), False, *(float(s.lower + p * (s.upper - s.lower)) for s, p in zip(specs, point))) for i, (v, point) in enumerate(zip(y, x))]
    rows += [(2, i, *r[2:]) for i, r in enumerate(rows[:30])]
    obs = spark.createDataFrame(rows, "campaign_id long, iteration long, kpi double, is_failure boolean, " + ", ".join(f"{s.name} double" for s in specs))
    names = ["campaign_id", *(s.name for s in specs)]
    take = lambda **more: kernels.suggest_gp(obs, specs, n=256, noise=0.05, **more).orderBy(*names).toPandas()
    one, parted = take(), take(most=100, block=256)  # the larger campaign as one matrix, and in blocks
    assert len(parted) == 512 and np.allclose(one[names], parted[names])
    for c in ("mean", "sigma", "gain"):
        assert np.abs(one[c] - parted[c]).max() < 1e-5 * y.std()


def test_samplers_take_few_rows(spark):
    """Ranks are drawn before rows are read; all draws are near one of the best quarter."""
    specs = (catalogue.LINE_SPECS[0],)
    rows = [(1, i, float(i), False, 1.0 + 49.0 * i / 99) for i in range(100)] + [(2, 0, float("nan"), False, 1.0), (2, 1, 1.0, False, 50.0), (2, 2, 5.0, True, 9.0)]
    obs = spark.createDataFrame(rows, "campaign_id long, iteration long, kpi double, is_failure boolean, p_quantity double")
    got = kernels.suggest_tpe(obs, specs, 40, width=1e-9).collect()
    assert len(got) == 80 and all(r.p_quantity >= 1.0 + 49.0 * 75 / 99 - 1e-3 for r in got if r.campaign_id == 1) and all(r.p_quantity > 49.9 for r in got if r.campaign_id == 2)
    wide = spark.createDataFrame([(1, i, float(v), "clash") for i, v in enumerate([1, 50, 20, 30, 30])] + [(2, 3, 7.0, ""), (3, 0, 5.0, ""), (3, 1, 5.0, ""), (3, 2, 5.0, "")], "campaign_id long, place long, p_quantity double, n_ string")
    few = [(r.campaign_id, r.place) for r in kernels.diversify(wide, specs, 3).collect()]
    assert sorted(few) == [(1, 0), (1, 1), (1, 3), (2, 3), (3, 0), (3, 0), (3, 0)]


def test_csv_to_observations(spark, tmp_path):
    (tmp_path / "plate.csv").write_text('x,kpi_y,note\n1,2.5,"a, b"\n,3, \nz,,c\n')
    rows = sorted(tables.observations(tables.read_csv(spark, str(tmp_path / "plate.csv"))).collect(), key=lambda r: r.iteration)
    assert {r.campaign_id for r in rows} == {"plate"}
    assert [r.parameters for r in rows] == [{"x": 1.0}, {}, {}]
    assert [r.kpi_values for r in rows] == [{"kpi_y": 2.5}, {"kpi_y": 3.0}, {}]
    assert [r.metadata for r in rows] == [{"note": "a, b"}, {}, {"x": "z", "note": "c"}]


def test_json_columns(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"a": [1, 2, 3], "b": ["x"], "c": 7}')
    rows = tables.columns_to_rows(tables.read_json(spark, str(tmp_path / "c.json"))).collect()
    assert [tuple(r) for r in rows] == [(1, "x", 7), (2, None, None), (3, None, None)]
    hashed = tables.canonical_json(spark.createDataFrame([(1, "x")], "b int, a string"), ["b", "a"]).first()
    assert hashed.canonical == '{"a":"x","b":1}' and len(hashed.row_hash) == 16


def test_profile_of_empty_table(spark):
    empty = campaign(spark, [1.0]).limit(0)
    assert store.summary(empty).count() == 0
    assert store.missing_report(empty, ["kpi"]).first().n_missing == 0


def test_skeleton_drops_indirect_links(spark):
    rng = np.random.default_rng(0)
    a = rng.standard_normal(800)
    b = a + 0.5 * rng.standard_normal(800)
    c = b + 0.5 * rng.standard_normal(800)
    rows = [tuple(map(float, r)) for r in zip(a, b, c, rng.standard_normal(800))]
    found = stats.skeleton(spark.createDataFrame(rows, "a double, b double, c double, d double"), ["a", "b", "c", "d"], 0.001)
    assert {(r.a, r.b) for r in found.collect()} == {("a", "b"), ("b", "c")}


def test_streams(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value")
    events.repartitionByRange(3, "ts").write.parquet(str(tmp_path / "in"))

    def run(df, mode, name):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        q.awaitTermination()
        return spark.table(name)

    stream = loop.event_stream(spark, str(tmp_path / "in"))
    health = run(loop.windowed_health(stream, late="400 days"), "complete", "health")
    assert health.agg(F.sum("n")).first()[0] == events.count()
    assert health.agg(F.sum("n_failed")).first()[0] == events.where("event_type = 'error'").count()
    twice = loop.once_only(stream.unionByName(stream), late="400 days")
    assert run(twice, "append", "once").count() == events.count()
    tried = run(loop.retries(stream), "update", "tried")
    assert tried.agg(F.sum("n_new")).first()[0] == events.count()

    best = lambda known: known.groupBy("user_id").agg(F.max("value").alias("best"))
    out = [str(tmp_path / x) for x in ("obs", "sugg", "ck")]
    loop.closed_loop(stream, best, *out).awaitTermination()
    assert spark.read.parquet(out[0]).count() == events.count()
    last = spark.read.parquet(out[1]).groupBy("user_id").agg(F.max_by("best", "batch").alias("best"))
    assert {tuple(r) for r in last.collect()} == {tuple(r) for r in best(events).collect()}

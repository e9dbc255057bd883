"""Nearest trials in blocks against all pairs, at sizes where pairs as rows would not do."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymark.model import Spec
from tallymark.operators import adjust, near, search

SPECS = (Spec("p_x", 0.0, 10.0), Spec("p_y", -1.0, 1.0))
TRIALS = "campaign_id long, iteration long, p_x double, p_y double, kpi double, is_failure boolean"


@pytest.mark.parametrize("block", [7, 1024])
def test_near_trials_are_those_of_all_pairs(spark, block):
    rng = random.Random(4)
    rows = [(c, i, float(rng.randint(0, 4)), rng.choice([-1.0, 0.0, 0.5]), rng.uniform(0, 9), rng.random() < 0.3) for c, n in ((1, 60), (2, 25), (3, 4)) for i in range(n)]
    rows += [(4, 0, 1.0, 0.0, 5.0, True), (4, 1, None, 0.0, 7.0, False), (4, 2, 9.0, 0.0, None, False), (5, 0, 1.0, 0.0, 1.0, True)]
    got = {(r.campaign_id, r.iteration): (r.n_near, r.kpi) for r in adjust.impute_near(spark.createDataFrame(rows, TRIALS).repartition(3), SPECS, 5, block).collect()}
    want = {}
    for c, i, x, y, _, failed in rows:
        if failed:
            apart = lambda o: (float("inf") if o[2] is None else np.sqrt(((x - o[2]) / 10) ** 2 + ((y - o[3]) / 2) ** 2), o[1])
            held = sorted((o for o in rows if o[0] == c and not o[5] and o[4] is not None), key=apart)[:5]
            want[c, i] = (len(held), pytest.approx(sum(o[4] for o in held) / len(held) if held else 0.0, abs=6e-4))
    assert got == want


def test_rounding_is_the_engines(spark):
    x = [0.0000005, 0.0000015, 0.1234565, 2.0000005, 0.3, 1 / 3, 1e-9, 7.4999995]
    told = [r.x for r in spark.createDataFrame([(v,) for v in x], "v double").select(F.round("v", 6).alias("x")).collect()]
    assert near.rounded(np.array(x), 6).tolist() == told


def test_no_pair_of_trials_is_a_row(spark):
    obs = spark.range(3000).select(F.lit(1).cast("long").alias("campaign_id"), F.col("id").alias("iteration"), (F.col("id") % 7).cast("double").alias("p_x"), F.lit(0.0).alias("p_y"), F.lit(1.0).alias("kpi"), (F.col("id") % 3 == 0).alias("is_failure"))
    for told in (adjust.impute_near(obs, SPECS), search.knn_failure(obs.withColumnRenamed("iteration", "candidate_id"), obs, ["p_x", "p_y"], [10.0, 2.0])):
        plan = told._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in plan and "row_number" not in plan


def test_text_search_scores_where_documents_are(spark, monkeypatch):
    """No pair of a query and a document is shuffled, and queries beyond what goes to every task find the same."""
    docs = spark.createDataFrame([(i, f"all w{i % 7} w{i % 5} w{i % 3} w{i % 3}") for i in range(60)] + [(60, None), (61, "")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "w1 w2"), (2, "all w4 w6"), (3, "unheard"), (4, "all")], "query_id long, text string")
    found = search.tfidf_search(docs, "doc_id", "text", asked, 5)
    assert "hashpartitioning(query_id#" not in "".join(n for n in found._jdf.queryExecution().executedPlan().toString().split("\n") if "doc_id" in n and "Exchange" in n)
    told = sorted(map(tuple, found.collect()))
    assert [sum(r[0] == q for r in told) for q in (1, 2, 3, 4)] == [5, 5, 0, 5]
    terms = {i: t.split() for i, t in docs.collect() if t}
    df = {t: sum(t in w for w in terms.values()) for w in terms.values() for t in w}
    weigh = lambda words: {t: words.count(t) / len(words) * np.log(61 / df[t]) for t in words if t in df}
    norm = lambda w: sum(x * x for x in w.values()) ** 0.5
    for q, text in asked.where("query_id != 3").collect():
        want, own = weigh(text.split()), {i: weigh(w) for i, w in terms.items()}
        scores = {i: round(sum(w[t] * want.get(t, 0) for t in w) / norm(w) / norm(want), 6) for i, w in own.items() if set(w) & set(want)}
        best = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:5]
        assert [(r[2], r[3]) for r in told if r[0] == q] == [(i, pytest.approx(v, abs=2e-6)) for i, v in best]
    monkeypatch.setattr(search, "ASKED", 0)
    assert sorted(map(tuple, search.tfidf_search(docs, "doc_id", "text", asked, 5).collect())) == told

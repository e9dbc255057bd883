"""The pipeline's stages against what they must keep, and the entry without it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tallymark.llm import mixing, quality
from tests.llm.test_core import brute_secrets

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    columns = docs.columns
    good = corpus_pipeline.keep_good(spark, docs, SF).cache()
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    share = docs.join(labels, "doc_id").select("doc_id", "quality").collect()
    kept = {r.doc_id for r in good.collect()}
    assert good.columns == columns and np.mean([(r.doc_id in kept) == (r.quality == 1) for r in share]) > 0.9

    single = corpus_pipeline.drop_near_copies(spark, good, SF).cache()
    assert single.columns == columns and 0 < single.count() <= good.select("text").distinct().count()

    clean = corpus_pipeline.hide_secrets(spark, single, SF).cache()
    rows = clean.collect()
    assert clean.columns == columns and len(rows) == single.count()
    assert all(brute_secrets(r.text) == "" and r.n_chars == len(r.text) for r in rows)

    mixed = corpus_pipeline.mix_sources(spark, clean, SF).cache()
    taken = {r.doc_id: (r.taken, r["size"]) for r in mixing.mix(clean).collect()}
    copies = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert mixed.columns == columns
    assert copies == {i: c for i, (t, s) in taken.items() if (c := int(t / s + 0.5) if s else 0)}

    packed = corpus_pipeline.pack_sequences(spark, mixed, SF)
    loads = packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert max(r.n for r in loads) <= 4096
    assert packed.where("start = 0").count() == mixed.count()


def test_near_copies_go(spark):
    rng = np.random.default_rng(4)
    words = [[f"w{x}" for x in rng.integers(0, 5000, 200)] for _ in range(12)]
    texts = [" ".join(w) for w in words] + [" ".join(w[:100] + ["other"] + w[101:]) for w in words] + [" ".join(words[0])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()) == list(range(12))


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0


def test_scores_are_independent_of_batches(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    a = {r.doc_id: r.quality_score for r in quality.score(docs, model).collect()}
    b = {r.doc_id: r.quality_score for r in quality.score(docs.orderBy(F.desc("doc_id")).repartition(3), model).collect()}
    assert max(abs(a[i] - b[i]) for i in a) < 1e-5

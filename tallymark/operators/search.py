"""Text search and nearest neighbours over the trial records."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import tidy
from ..sources.tables import keep
from . import near

# Documents of a task, and terms of queries that go to every task, at most.
TASK_DOCS, ASKED = 1 << 13, 1 << 20


def tokens(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Each document's terms (lower case, letters, digits and underscores) with their counts and the document's length."""
    # The words are a column of their own: beside explode() their count would be taken anew for every word.
    words = docs.select(F.col(key), F.regexp_extract_all(F.lower(F.col(text)), F.lit("[a-z0-9_]+"), F.lit(0)).alias("words"))
    rows = words.select(F.col(key), F.size("words").alias("n_terms"), F.explode("words").alias("term"))
    return rows.groupBy(key, "n_terms", "term").agg(F.count("*").alias("tf"))


def tfidf_search(docs: DataFrame, key: str, text: str, queries: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` documents of highest TF-IDF cosine to each query of ``queries`` (query_id, text).

    Only documents that share a term with a query are scored.  Texts are dealt by document once, so that terms are counted and queries scored
    where a document is, and only a task's ``k`` best of a query leave it; norms need all terms by word once more.  The queries' terms go to
    every task if they are at most ASKED rows.
    """
    spark = docs.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // TASK_DOCS))
    texts = docs.select(key, text).repartition(tasks, key)
    terms = tokens(texts, key, text)
    n_docs = docs.where(F.col(text).isNotNull()).agg(F.count("*").alias("n_docs"))
    df = terms.groupBy("term").agg(F.count("*").alias("df"))
    idf = df.join(F.broadcast(n_docs)).select("term", F.ln(F.col("n_docs") / F.col("df")).alias("idf"))  # n_docs is one row
    idf = keep(idf, "term-weights")
    weight = F.col("tf") / F.col("n_terms") * F.col("idf")
    norms = terms.join(idf, "term").groupBy(key).agg(F.sqrt(F.sum(weight * weight)).alias("norm"))
    asked = tokens(queries, "query_id", "text").join(idf, "term").select("query_id", "term", "idf", weight.alias("qw"))
    qnorm = F.sqrt(F.sum(F.col("qw") * F.col("qw")).over(Window.partitionBy("query_id")))
    asked = keep(asked.withColumn("qnorm", qnorm), "asked-terms")
    hits = terms.join(F.broadcast(asked) if asked.count() <= ASKED else asked, "term").groupBy("query_id", key, "qnorm").agg(F.sum(weight * F.col("qw")).alias("dot"))
    scored = hits.join(norms, key).where("norm > 0 AND qnorm > 0").withColumn("score", tidy(F.col("dot") / F.col("norm") / F.col("qnorm")))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), key))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", key, "score")


def ngram_jaccard(pairs: DataFrame, a: str, b: str, n: int = 3) -> DataFrame:
    """Jaccard likeness of two strings' character n-grams; a shorter string is its own n-gram, two empty ones are alike."""

    def grams(c: str):
        text = F.col(c)
        many = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(n))))
        return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(many)

    both, either = F.size(F.array_intersect(grams(a), grams(b))), F.size(F.array_union(grams(a), grams(b)))
    return pairs.withColumn("likeness", tidy(F.when(either == 0, 1.0).otherwise(both / either)))


def knn_failure(candidates: DataFrame, obs: DataFrame, params: list[str], scales: list[float], k: int = 5) -> DataFrame:
    """Share of failures among each candidate's ``k`` nearest trials of its campaign, by scaled distance then iteration.

    A candidate of a campaign without trials has no row.
    """

    def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return near.rounded(sum(((a[:, i, None] - b[None, :, i]) ** 2 for i in range(a.shape[1])), np.zeros((len(a), len(b)))), 6)

    told = near.nearest(candidates, obs, "candidate_id", "iteration", [F.col(p) / s for p, s in zip(params, scales)], F.col("is_failure").cast("double"), apart, k).where(F.size("near") > 0)
    known = F.filter("near", lambda o: ~F.isnan(o["y"]))["y"]
    mean = F.aggregate(known, F.lit(0.0), lambda a, y: a + y) / F.when(F.size(known) > 0, F.size(known))
    far = F.array_max(F.filter("near", lambda o: o["d"] < float("inf"))["d"])
    return told.select("campaign_id", "candidate_id", tidy(mean).alias("p_failure"), tidy(far).alias("radius"))


def centroids(vectors: DataFrame, label: str, embedding: str) -> DataFrame:
    """Each label's mean vector in long form."""
    parts = vectors.select(label, F.posexplode(embedding).alias("dim", "x"))
    return parts.groupBy(label, "dim").agg(F.count("*").alias("n"), tidy(F.avg("x")).alias("mean"))

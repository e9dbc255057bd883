"""A training corpus from raw documents, stage by stage.

Each stage takes (spark, docs, sf_dir), docs being all that its predecessor kept, and returns a DataFrame: the columns
of documents, or for the last stage the packed pieces.  ``run`` writes every stage's rows as Parquet in the cluster's
shared folder and reads them again for the next one, so a lost executor repeats one stage's tasks at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm import langid, mixing, packing, quality, secrets, simhash
from tallymark.llm.queries import tokenizer_path
from tallymark.llm.scratch import table

ACCEPT = 0.5


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learned from the labels it may see, scores at ACCEPT or more."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~langid.held_out(F.col("doc_id"), 3, 1))
    model = quality.fit(docs, labels)
    return quality.keep(docs, model, ACCEPT)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of the least id."""
    return simhash.keep_one(docs)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, as often as the mix of the sources takes them."""
    return mixing.resample(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 4096 tokens."""
    return packing.pack(docs, tokenizer_path(), frugal=True)


STAGES = [
    ("quality classifier", keep_good),
    ("simhash near-dedup", drop_near_copies),
    ("secret scans", hide_secrets),
    ("source mixing", mix_sources),
    ("packing", pack_sequences),
]

# The classifier's scores have no SQL form; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = table(docs, name.replace(" ", "-"))
    return docs

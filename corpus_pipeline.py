"""A training corpus from raw documents: toxic texts go, of near copies one stays, secrets are blanked, sources are
mixed to their target weights, and what is left is packed into batches.

STAGES: (name, function of (spark, docs, sf_dir)). Each stage's result is written and read again as the next one's
docs; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frostline.llm import jaccard_join, mixing, packing, secret_scans, toxicity
from frostline.sources.shared import drop_written, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels of this table, doesn't take for toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.without_toxic(docs, toxicity.train(docs, labels))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact or near copies: five words and 0.8; rows without an id are copies as well."""
    return jaccard_join.without_copies(docs, jaccard_join.Settings(words=5, percent=80), null_ids=True)


def blank_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a placeholder for every secret; n_chars follows the text."""
    model = secret_scans.train(secret_scans.labelled_samples(docs))
    clean = docs.withColumn("text", secret_scans.redacted(F.col("text"), model))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed(docs)


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every document in the batches."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_copies),
    ("secret scans", blank_secrets),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack_batches),
]

ORACLE_SQL = None  # classifiers, similarity classes of hashed order and batches; tests/llm has a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of a folder. A stage's table is deleted once the next one is written."""
    docs, stored = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "pipeline")
        if stored is not None:
            drop_written(stored)  # the stage before has been read whole
        stored = docs
    return STAGES[-1][1](spark, docs, sf_dir)

"""The cleaning pipeline over documents: each stage is one operator of ``brickledger.llm``.

A stage takes the documents its predecessor kept and returns those it keeps,
with the same columns.  The last one deals them to padded batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brickledger.llm import mixing, packing, secrets, simhash, toxicity
from brickledger.llm.common import word_count
from brickledger.operators.storage import new_path, remove, scratch

TOXIC_FROM = 0.7
MIX_WEIGHTS = (5.0, 2.0, 1.0)
BATCH_TOKENS = 16_384
BUCKETS = 32


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores as toxic go; it learns from two thirds of the labelled ids."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels, F.crc32(F.col("id").cast("string")) % 3 != 1)
    return toxicity.keep_clean(docs, model, TOXIC_FROM)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity 0.8."""
    return simhash.one_of_each(docs, width=5, similarity=0.8)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; secrets in their texts are replaced by the name of their kind."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that each source has its share of the words."""
    return mixing.repeated(mixing.mix(docs, word_count("text"), mixing.cyclic_weights(MIX_WEIGHTS)))


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bucket, padded length, batch and place of every document."""
    packed = packing.pack(docs, word_count("text"), BATCH_TOKENS, BUCKETS)
    return packed.select(F.col("id").alias("doc_id"), F.col("length").alias("n_words"), "bucket", "pad_to", "batch", "place")


STAGES = [
    ("toxicity", drop_toxic), ("near_duplicates", drop_near_copies), ("secrets", redact_secrets), ("mixing", mix_sources),
    ("packing", pack_batches),
]
ORACLE_SQL = None  # classifier, fingerprints and dynamic program have no SQL form


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's own tables, and the documents it has read, are deleted when it has ended."""
    docs, read = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = new_path(spark, name)
        with scratch(spark):
            kept = stage(spark, docs, sf_dir)
            kept.write.parquet(path)
        if read:
            remove(spark, read)
        docs, read = spark.read.schema(kept.schema).parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)

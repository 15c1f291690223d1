"""The operators as queries over the driver tables, with their production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.storage import new_path
from . import ann, conversations, exact_topk, interpolation, mixing, packing, secrets, simhash, token_counts, toxicity, vector_dedup, warc, whitening
from .common import word_count
from .conversation_sql import repair_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicate_classes(table(spark, sf_dir, "documents"), width=3, limit=2)
    return found.select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("class").alias("component_id"))


@query
def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_topk.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5, factor=256)
    return found.withColumnRenamed("id", "vec_id")


ORACLES["op7_exact_top_k"] = """
WITH v AS (SELECT vec_id, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS w FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
     s AS (SELECT q.vec_id AS query_id, c.vec_id,
                  list_sum([p[1] * p[2] FOR p IN list_zip(q.w, c.w)])::BIGINT AS score
           FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
     r AS (SELECT query_id, vec_id, score,
                  row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@query
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), path, compressed=True, least_bytes=0)
    records = warc.read(spark, path, with_payload=False)
    return records.filter(~warc.is_gap()).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


@query
def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def of(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin(secrets.BASE_KINDS))
    return found.select(
        F.col("id").alias("doc_id"), of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"),
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


@query
def op2_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), word_count("text"), mixing.cyclic_weights((5.0, 2.0, 1.0)), keep=["doc_id"])
    return mixed.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@query
def op3_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), word_count("text"), budget=16_384, buckets=32)
    return packed.select(F.col("id").alias("doc_id"), F.col("length").alias("n_words"), "bucket", "pad_to", "batch", "place")


def crc_remainder(column: str, parts: int):
    return F.crc32(F.col(column).cast("string")) % parts


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), crc_remainder("id", 3) != 1)
    return toxicity.score(docs, model).select(
        F.col("id").alias("doc_id"), F.coalesce(crc_remainder("id", 3) == 1, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query
def op1_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ann.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5)
    return found.withColumnRenamed("id", "vec_id")


@query
def op5_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = interpolation.score(table(spark, sf_dir, "documents"), crc_remainder("id", 7) != 2)
    return scored.select(
        F.col("id").alias("doc_id"), F.coalesce(crc_remainder("id", 7) == 2, F.lit(False)).alias("held_out"),
        "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(table(spark, sf_dir, "embeddings"), components=32, grid=64, offset=1_000_000)
    return found.withColumnRenamed("id", "vec_id").withColumn("deviation", F.col("deviation").cast("long"))


@query
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = table(spark, sf_dir, "conversations")
    fixed = conversations.repair(conversations.damaged(source))
    lines = conversations.digests(fixed.rows).withColumnRenamed("conv", "_conv")
    known = fixed.summary.join(lines, F.col("conv").eqNullSafe(F.col("_conv")))
    found = source.select("conv_id").distinct().join(known, F.col("conv_id").eqNullSafe(F.col("conv")), "left")
    counts = [F.coalesce(name, F.lit(0)).cast("long").alias(name) for name in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"),
                        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


ORACLES["op12_conversation_repair"] = repair_sql()


@query
def op13_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vector_dedup.near_copies(table(spark, sf_dir, "embeddings"), similarity=0.93)
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


ORACLES["op13_embedding_near_dedup"] = """
WITH RECURSIVE v AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0),
link AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
    WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
found AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
counted AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT e.vec_id, coalesce(c.n, 0)::BIGINT AS n_links, f.component_id, e.vec_id = f.component_id AS kept
FROM embeddings e JOIN found f ON f.a = e.vec_id LEFT JOIN counted c ON c.a = e.vec_id
"""

"""The queries of this subpackage's operators, with production parameters, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chunk_codec, fingerprints, langid, neardup, packing, prefix_counts, token_files, topk, toxicity, warc
from .common import shared_dir, table

BYTE_BPE, WORD_BPE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write_token_files(table(spark, sf_dir, "documents"), BYTE_BPE, shared_dir(spark, "token-files"), end_id=0)
    return token_files.read_token_files(spark, manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), langid.crc_mod("doc_id", 4) != 2)
    return toxicity.score(docs, model).select("doc_id", (langid.crc_mod("doc_id", 4) == 2).alias("held_out"), "score", "predicted", F.size("words").alias("n_words"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    models = langid.train(docs, langid.crc_mod("doc_id", 5) != 0)
    found = langid.identify(docs, models).withColumn("held_out", langid.crc_mod("doc_id", 5) == 0)
    return found.select("doc_id", "held_out", "lang_pred", "score", "rejected", "bits_per_char")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole, single = shared_dir(spark, "warc-whole"), shared_dir(spark, "warc")
    files = warc.write_archives(table(spark, sf_dir, "pages"), whole, min_bytes=0)
    files = [name for name, _ in warc.normalise(spark, whole, files, single)]
    return warc.read_archives(spark, single, files).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprints.fingerprints(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_chars", F.sha2(F.encode("edited_text", "UTF-8"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op7_prefix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = prefix_counts.prefix_counts(table(spark, sf_dir, "documents"), BYTE_BPE)
    whole = prefix_counts.tokens_at(F.col("counts"), F.col("n_chars"))
    return counts.select("doc_id", "n_bytes", whole.alias("n_tokens")).withColumn("over_limit", F.col("n_tokens") > 512)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), WORD_BPE, max_length=2048, end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


def op9_chunk_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = chunk_codec.encode_decode(table(spark, sf_dir, "documents"), BYTE_BPE)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(topk.quantised(table(spark, sf_dir, "embeddings")), k=5, every=50)


OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, html, strlen(html) AS payload_bytes, sha1(html) AS h,
             max(page_id) OVER (PARTITION BY html) AS keeper FROM p),
v AS (SELECT *, list_transform(range(0, 8), lambda g: CAST('0x' || substr(h, 5 * g + 1, 5) AS INTEGER)) AS w FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
       list_aggregate(list_transform(w, lambda x:
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x >> 15) % 32 + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x >> 10) % 32 + 1, 1) ||
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x >> 5) % 32 + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', x % 32 + 1, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = keeper THEN NULL ELSE keeper END AS refers_to
FROM v
"""

OP10_SQL = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""


def queries() -> dict:
    return {
        "op1_token_files": op1_token_files,
        "op2_near_duplicates": op2_near_duplicates,
        "op3_toxicity": op3_toxicity,
        "op4_language_id": op4_language_id,
        "op5_warc": op5_warc,
        "op6_fingerprints": op6_fingerprints,
        "op7_prefix_counts": op7_prefix_counts,
        "op8_packing": op8_packing,
        "op9_chunk_codec": op9_chunk_codec,
        "op10_top_k": op10_top_k,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_warc": OP5_SQL, "op10_top_k": OP10_SQL}

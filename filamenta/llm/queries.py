"""Registered queries of this subpackage, and the SQL of those that SQL expresses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe_codec import encode_decode
from .common import table
from .conversation_repair import damaged, repair_conversations
from .jaccard_join import jaccard_components
from .licenses import scan_licenses
from .minhash import minhash_groups
from .packing import pack
from .piecewise_hash import piecewise_fingerprints
from .posting_lists import nearest_neighbours
from .sharding import shard_documents
from .surrogates import REGISTERED_KEY, key_of, replace_personal_data
from .toxicity import score_toxicity
from .warc import archive_round_trip
from .whitening import whiten


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op2_balanced_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), 8)


def op3_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), vocabulary_path())


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the session's key, or REGISTERED_KEY, so that runs agree."""
    return replace_personal_data(table(spark, sf_dir, "documents"), key_of(spark, REGISTERED_KEY)).select("doc_id", "text", "n_replaced")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary_path())


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(table(spark, sf_dir, "pages"))


def op10_piecewise_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piecewise_fingerprints(table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(damaged(table(spark, sf_dir, "conversations"))).drop("repaired")


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_groups(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_posting_lists, op2_balanced_propagation, op3_tree_bpe, op4_toxicity, op5_surrogates, op6_licenses, op7_jaccard_join, op8_packing, op9_warc, op10_piecewise_hash, op11_whitening, op12_conversation_repair, op13_minhash, pipeline)}

ORACLE_SQL = {
    "op9_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
        low AS (SELECT digest, min(page_id) AS low FROM p WHERE n >= 100 GROUP BY digest)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.digest AS payload_digest,
               CASE WHEN low IS NOT NULL AND page_id IS DISTINCT FROM low THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN low IS NOT NULL AND page_id IS DISTINCT FROM low THEN low END AS refers_to
        FROM p LEFT JOIN low ON p.digest = low.digest
    """,
}

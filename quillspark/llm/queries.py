"""The registered queries of the operators: digests of what the operators return."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, conversations, embedding, licenses, mixing, near_dup, phrases, pii, quality, substring, suffixes, token_ids, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_ids(spark, sf_dir):
    return token_ids.digest(table(spark, sf_dir, "documents"))


def op2_near_dup(spark, sf_dir):
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op3_quality(spark, sf_dir):
    return quality.quality_rules(table(spark, sf_dir, "documents"))


def op4_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).drop("starts")


def op5_embedding(spark, sf_dir):
    return embedding.embedding_duplicates(table(spark, sf_dir, "embeddings"))


def op6_toxicity(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_bpe(spark, sf_dir):
    return bpe.digest(table(spark, sf_dir, "documents"))


def op8_suffixes(spark, sf_dir):
    return suffixes.digest(table(spark, sf_dir, "documents"))


def op9_substring(spark, sf_dir):
    return substring.digest(table(spark, sf_dir, "documents"))


def op10_licenses(spark, sf_dir):
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op11_phrases(spark, sf_dir):
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_pii(spark, sf_dir):
    return pii.digest(table(spark, sf_dir, "documents"))


def op13_conversations(spark, sf_dir):
    return conversations.digest(table(spark, sf_dir, "conversations"))


QUERIES = (op1_token_ids, op2_near_dup, op3_quality, op4_mixing, op5_embedding, op6_toxicity, op7_bpe, op8_suffixes, op9_substring, op10_licenses, op11_phrases, op12_pii, op13_conversations)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op3_quality": quality.oracle(), "op4_mixing": mixing.ORACLE_SQL, "op9_substring": substring.oracle(), "op10_licenses": licenses.oracle(), "op11_phrases": phrases.ORACLE_SQL}

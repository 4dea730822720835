"""The corpus pipeline: documents without toxic, near-duplicate and repeated text, mixed to target
weights and encoded. Each stage is a table in the shared folder that the next one reads.

Every stage takes any table with the columns of documents; further columns are left out, whatever
their names. An empty table gives an empty one, and texts of any length are whole rows. What the
stages do with null ids, null and empty texts and repeated rows stands with each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import bpe, mixing, near_dup, substring, toxicity
from quillspark.llm.common import Scratch

#: Bytes of an encoder's tables of pieces and of runs.
ENCODER_BYTES = (8 << 20, 32 << 20)
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score under the cut, as they are: null and empty texts have no votes and stay, and
    repeated rows share their fate."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = toxicity.scored(docs, toxicity.fit(docs, labels), COLUMNS)
    return rows.where(F.col("score") < toxicity.CUT).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked documents, that with the smallest doc_id. Rows that share an id
    are one document: of them the smallest by text, lang, source and n_chars stays. Rows without an
    id are duplicates of none and stay; so do texts without words."""
    kept = near_dup.near_duplicates(docs).where("kept and doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows"))
    kept = Scratch(spark, "pipeline").put(kept, "kept")
    once = docs.join(kept.where("rows = 1"), "doc_id", "left_semi").select(*COLUMNS)
    out = once.unionByName(docs.where("doc_id is null").select(*COLUMNS))
    if kept.where("rows > 1").limit(1).count():
        several = docs.join(kept.where("rows > 1"), "doc_id", "left_semi")
        least = several.groupBy("doc_id").agg(F.min(F.struct(*COLUMNS[1:])).alias("row"))
        out = out.unionByName(least.select("doc_id", "row.*"))
    return out


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows; a text without repeated passages stays byte for byte, and one with them loses these
    words and the white space up to the next. A null text becomes an empty one."""
    rows = substring.remove_repeats(docs, carry=["lang", "source"], layout=True)
    return rows.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes its words, to the nearest whole number of times, so that
    rows of which it takes less than half, and texts without words, are not in the mix. Rows are told
    apart by id and text, with or without an id; those that share both are taken equally often."""
    rows = mixing.mix(docs).groupBy("doc_id", "mark").agg(F.sum("taken").alias("taken"), F.sum("size").alias("size"))
    rows = rows.where("taken > 0").withColumn("times", F.floor(F.col("taken") / F.col("size") + 0.5).cast("int")).where("times > 0").select(F.col("doc_id").alias("id"), "mark", "times")
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.md5(F.coalesce("text", F.lit(""))) == F.col("mark"))
    return docs.select(*COLUMNS).join(rows, same).select(*COLUMNS, F.explode(F.sequence(F.lit(1), "times"))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the ids themselves as little-endian unsigned 32-bit integers, and digests of
    the ids and of what they decode to. Null and empty texts have no ids; a null id stays null. The
    workers of earlier stages all become encoders here, so each has smaller tables."""
    return bpe.encode_texts(docs, most_bytes=ENCODER_BYTES)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("repeated_passages", drop_repeats), ("mixing", mix_sources), ("encoding", encode)]
#: A label model, register bands and the merges are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, before = Scratch(spark, "pipeline"), None
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.put(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {}

"""Training-data pipeline over ``documents``.

Quality rules, language identification, exact dedup, near-dedup and packing:
each stage works on all that its predecessor kept. A stage takes (spark, docs,
sf_dir); its result is written as Parquet and read again as the next one's docs.
All but the last keep the columns of ``documents``.

A row is known by its id and its text: of rows equal in both one stays at exact
dedup, and rows without an id pass the near-dedup. An empty table gives no
sequences. Further columns are carried along until packing.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from frostline.llm import content_sort, langid, minhash, packing, quality
from frostline.llm.common import documents, drop, settle


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_known(docs)


def _rows(docs: DataFrame) -> DataFrame:
    """Each row as one column, so that no column of its own can clash, with its id and text hash."""
    return docs.select(F.struct("*").alias("doc"), F.col("doc_id").alias("id"),
                       F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = (content_sort.exact_dedup(docs).filter("kept")
            .select(F.col("doc_id").alias("keep_id"), F.col("text_hash").alias("keep_hash")))
    same = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("hash") == F.col("keep_hash"))
    place = F.row_number().over(Window.partitionBy("id", "hash").orderBy("hash"))
    return (_rows(docs).join(kept, same, "left_semi").withColumn("place", place).filter("place = 1")
            .select("doc.*"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    dropped = (minhash.near_duplicates(docs).filter("NOT kept")
               .select(F.col("doc_id").alias("drop_id"), F.col("text_hash").alias("drop_hash")))
    same = (F.col("id") == F.col("drop_id")) & (F.col("hash") == F.col("drop_hash"))
    return _rows(docs).join(dropped, same, "left_anti").select("doc.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("packing", packing_stage),
]

#: MinHash and tokenizers have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
        if before is not None:  # a stage's input goes once its result stands
            drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)

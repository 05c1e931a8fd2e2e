"""Exact dedup by content sort.

Rows are range-partitioned by their normalised bytes at sampled splitters,
sorted there by the whole normalised text (external, spilling sort), and each
run of equal neighbours names the row that stays. Neighbours are compared in
full; the digest only spreads texts that share a beginning.

Texts so frequent that one would outweigh a quarter of a partition are found
in a sample and dealt over several partitions ("salts"); the few winners of
these are compared once more. The sample only steers the dealing: missing a
frequent text costs balance, never a result.

Defined cases: null text counts as empty; all empty texts are one group. A
null doc_id is a row like any other and loses ties. Identical rows (equal id
and text) keep one of them. Columns other than id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frostline.llm.common import WORD_BREAK, settle, shuffle_partitions

#: Characters of the normalised text that splitters see, so that a sampled key stays small.
HEAD = 64
#: Frequent texts up to this number (some 50 MB) go to every task; more meet the rows in a join.
SENT_TEXTS = 500_000
#: Sampled rows per shuffle partition, and how many of one text make it frequent:
#: 128 per partition and 16 alike mean an eighth of a partition's share.
SAMPLE_PER_PARTITION, FREQUENT = 128, 16


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WORD_BREAK, "")


def frequent_texts(docs: DataFrame, text: str, partitions: int) -> DataFrame:
    """(digest, salts) of texts that outweigh a share of a partition. At most
    SAMPLE_PER_PARTITION / FREQUENT rows per partition, whatever the input."""
    rate = min(1.0, SAMPLE_PER_PARTITION * partitions / max(1, docs.count()))
    return (docs.select(text).sample(rate, seed=7)
            .groupBy(F.sha2(normalised(F.col(text)), 256).alias("digest")).count()
            .filter(F.col("count") >= FREQUENT)
            .select("digest", F.ceil(F.col("count") / FREQUENT).cast("int").alias("salts")))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: id, ``text_hash`` (of the raw text), ``keep_id``,
    ``group_size``, ``kept`` and ``digest`` (SHA-256 of the normalised text)."""
    n = shuffle_partitions(docs.sparkSession)
    base = (docs.select(F.col(id_col).alias("doc_id"),
                        F.coalesce(F.length(text), F.lit(0)).alias("points"),
                        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"),
                        normalised(F.col(text)).alias("norm"), F.monotonically_increasing_id().alias("row"))
            .withColumn("digest", F.sha2("norm", 256)))
    frequent = settle(frequent_texts(docs, text, n), "frequent-texts")
    if frequent.count() <= SENT_TEXTS:
        frequent = F.broadcast(frequent)
    # dealt by the row's place in the scan: rows without an id are spread as well
    dealt = (base.join(frequent, "digest", "left")
             .withColumn("head", F.substring("norm", 1, HEAD))
             .withColumn("salt", F.coalesce(F.pmod(F.xxhash64("row"), F.col("salts")), F.lit(0).cast("long")))
             .repartitionByRange(n, "head", "digest", "salt"))
    # the range partitioning already holds equal (head, digest, salt) together: no further exchange
    run = Window.partitionBy("head", "digest", "salt", "norm")
    best = run.orderBy(F.desc("points"), F.asc_nulls_last("doc_id"))
    local = settle(
        dealt.select("doc_id", "text_hash", "points", "digest", "salt", "norm",
                     F.col("salts").isNotNull().alias("frequent"),
                     F.row_number().over(best).alias("place"),
                     F.first("doc_id").over(best).alias("keep_id"),
                     F.count(F.lit(1)).over(run).alias("group_size"))
        .withColumn("norm", F.when(F.col("frequent") & (F.col("place") == 1), F.col("norm"))),
        "content-sort")
    group = Window.partitionBy("digest", "norm")
    winners = (local.filter(F.col("frequent") & (F.col("place") == 1))
               .select(F.col("digest").alias("w_digest"), F.col("salt").alias("w_salt"), F.col("keep_id").alias("w_keep"),
                       F.first("keep_id").over(group.orderBy(F.desc("points"), F.asc_nulls_last("keep_id"))).alias("final_keep"),
                       F.sum("group_size").over(group).alias("final_size")))
    same = (F.col("frequent") & (F.col("digest") == F.col("w_digest")) & (F.col("salt") == F.col("w_salt"))
            & F.col("keep_id").eqNullSafe(F.col("w_keep")))
    keep = F.when(F.col("final_size").isNotNull(), F.col("final_keep")).otherwise(F.col("keep_id"))
    return (local.drop("norm").join(winners, same, "left")
            .select("doc_id", "text_hash", keep.alias("keep_id"),
                    F.coalesce("final_size", "group_size").alias("group_size"),
                    ((F.col("place") == 1) & F.col("keep_id").eqNullSafe(keep)).alias("kept"), "digest"))


def op10_content_sort(spark, sf_dir):
    """Exact dedup of all documents by content sort."""
    from frostline.llm.common import documents
    return (exact_dedup(documents(spark, sf_dir))
            .select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256")))


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm
  FROM documents),
k AS (
  SELECT doc_id, norm, count(*) OVER (PARTITION BY norm) AS group_size,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id) AS keep_id
  FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM k
"""

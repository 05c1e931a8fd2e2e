"""Sharding by proportional stratified interleaving.

Within each source, rows are ranked in a seeded shuffle; row r of n gets the
fraction (r - 1 + p) / n, where p spreads the sources of one size evenly over
(0, 1), so that many tiny sources don't meet at one place; all rows are sorted
by fraction and cut into equal runs: every shard holds each source in proportion.

Neither ranking sorts a source or the table in one task: rows are counted by
(source, bucket) and by slice of fractions, the running sums of these small
counts give each bucket its first rank, and only inside a bucket are rows
ranked by a sort. Buckets follow the row count, so a bucket stays small. The
running sums themselves go over spans of buckets first, then inside each span.

Defined cases: a null source is a source of its own; null text has no bytes;
null ids and repeated rows are rows like any other. An empty table gives no rows.
Columns other than id, text and source are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frostline.llm.common import documents, settle

#: Rows that one bucket of a ranking should hold.
BUCKET_ROWS = 500
#: Buckets whose counts one task adds up.
SPAN = 1_000


def ranked(rows: DataFrame, group: list[str], bucket: Column, order: list, name: str, of_group=lambda starts: starts) -> DataFrame:
    """Adds ``name``, the 1-based rank of a row in its group, and ``<name>_of``,
    the group's size. ``bucket``, a whole number, must not decrease along ``order``. ``of_group``
    may add columns of the group to the small table of (group, bucket)."""
    keys, spanned = [*group, "_bucket"], [*group, "_span"]
    rows = rows.withColumn("_bucket", bucket.cast("long"))
    counts = (rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
              .withColumn("_span", F.expr(f"_bucket div {SPAN}")))
    whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    spans = counts.groupBy(*spanned).agg(F.sum("_n").alias("_s")).select(
        *spanned, (F.sum("_s").over(whole.orderBy("_span")) - F.col("_s")).alias("_before"),
        F.sum("_s").over(whole).alias(f"{name}_of"))
    inside_span = F.sum("_n").over(Window.partitionBy(*spanned).orderBy("_bucket")) - F.col("_n")
    starts = (counts.select(*keys, "_span", inside_span.alias("_inside")).join(spans, spanned)
              .select(*keys, (F.col("_before") + F.col("_inside")).alias("_first"), f"{name}_of"))
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return (rows.withColumn(name, inside).join(of_group(starts), keys)
            .withColumn(name, F.col(name) + F.col("_first")).drop("_bucket", "_first"))


def interleave(docs: DataFrame, shards: int, seed: int = 17, id_col: str = "doc_id",
               text: str = "text", source: str = "source") -> DataFrame:
    """One row per document: id, size, text_crc32, shard and slot (0, 1, ... in the shard)."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = settle(docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(body) + 16).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("")).alias("stratum"),
        F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")), 256).alias("draw")), "shard-rows")
    total = rows.count()
    buckets = max(1, -(-total // BUCKET_ROWS))
    # the draw's leading 32 bits rise with the draw itself
    lead = F.conv(F.substring("draw", 1, 8), 16, 10).cast("long")
    by_draw = F.floor(lead * F.lit(buckets) / F.lit(1 << 32))
    order = ["draw", F.asc_nulls_last("doc_id"), "text_crc32", "size"]

    def phased(starts: DataFrame) -> DataFrame:
        """Adds the place of each source among those of its size."""
        sources = starts.select(F.col("stratum").alias("of"), F.col("rank_of").alias("n")).distinct()
        same_size = Window.partitionBy("n")
        nth = F.row_number().over(same_size.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), "of"), 256), "of"))
        phase = (nth - F.lit(0.5)) / F.count(F.lit(1)).over(same_size)
        return starts.join(sources.select("of", phase.alias("phase")), F.col("stratum") == F.col("of")).drop("of")

    mixed = ranked(rows, ["stratum"], by_draw, order, "rank", phased).withColumn(
        "fraction", ((F.col("rank") - 1).cast("double") + F.col("phase")) / F.col("rank_of").cast("double"))
    placed = ranked(mixed, [], F.floor(F.col("fraction") * buckets), ["fraction", "stratum", *order], "position")
    # shard s takes the positions from ceil(s * total / shards) on: counts are at most one apart
    at = F.col("position") - 1
    shard = F.expr(f"(position - 1) * {shards} div {max(total, 1)}")
    first = F.expr(f"(shard * {max(total, 1)} + {shards - 1}) div {shards}")
    return (placed.withColumn("shard", shard)
            .select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"),
                    (at - first).alias("slot")))


def op6_interleave(spark, sf_dir):
    """All documents into 40 shards whose row counts are at most one apart."""
    return (interleave(documents(spark, sf_dir), 40)
            .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                    F.lit(None).cast("int").alias("grown_shard")))


OP6_SQL = """
WITH RECURSIVE step(i, k, v) AS (
  SELECT i, 0, i::BIGINT FROM range(256) t(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM step WHERE k < 8),
crc AS (SELECT list(v ORDER BY i) AS tab FROM step WHERE k = 8),
d AS (
  SELECT doc_id, coalesce(text, '') AS body, coalesce('s' || source, '') AS stratum,
         sha256('17' || coalesce(':' || doc_id::VARCHAR, '')) AS draw
  FROM documents),
b AS (
  SELECT doc_id, stratum, draw, strlen(body) AS bytes, hex(encode(body)) AS hx FROM d),
c AS (
  SELECT doc_id, stratum, draw, bytes + 16 AS size,
         xor(4294967295, list_reduce(
           list_concat([4294967295::BIGINT], list_transform(range(bytes), lambda i: ('0x' || substr(hx, (2 * i + 1)::BIGINT, 2))::BIGINT)),
           lambda a, x: xor(a >> 8, tab[xor(a & 255, x) + 1]))) AS text_crc32
  FROM b, crc),
r AS (
  SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY draw, doc_id, text_crc32, size) AS rk,
         count(*) OVER (PARTITION BY stratum) AS n, count(*) OVER () AS total
  FROM c),
s AS (
  SELECT stratum AS of, (row_number() OVER (PARTITION BY n ORDER BY sha256('17:' || stratum), stratum) - 0.5::DOUBLE)
         / count(*) OVER (PARTITION BY n) AS phase
  FROM (SELECT DISTINCT stratum, n FROM r)),
p AS (
  SELECT r.*, row_number() OVER (ORDER BY ((rk - 1)::DOUBLE + phase) / n::DOUBLE, stratum, draw, doc_id, text_crc32, size) - 1 AS pos
  FROM r JOIN s ON s.of = r.stratum)
SELECT doc_id, size, text_crc32, 'rows' AS law, (pos * 40 // total)::INTEGER AS shard,
       pos - ((pos * 40 // total) * total + 39) // 40 AS slot, NULL::INTEGER AS grown_shard
FROM p
"""

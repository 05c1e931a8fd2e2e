"""Backtests over frozen snapshots: as-of lookups, strategy scores, query checks.

As-of lookups are not range joins: the observations and the lookup points are unioned and
cut into slices of (key, time) by a range partitioning, so one long history lies in many slices. Inside a
slice each lookup takes the last observation at or before it (``last(..., ignorenulls)`` over a running
frame); one that finds none takes the last of the key's earlier slices, which a small table (a row
for each key and slice) hands on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frostline import params
from frostline.functions import text
from frostline.session import settled


def asof(obs: DataFrame, points: DataFrame, key: str, obs_time: str, point_time: str,
         values: list[str]) -> DataFrame:
    """For each row of ``points``, the latest ``obs`` row of the same key whose
    time is at or before the point's time. Adds ``asof_<obs_time>`` and
    ``asof_<value>`` columns (NULL when there is none)."""
    # one struct through the window: a NULL value never lends its day to an older value
    seen = F.struct(F.col(obs_time).alias("t"), *[F.col(v).alias(v) for v in values])
    o = obs.where(F.col(obs_time).isNotNull()).select(
        F.col(key), F.col(obs_time).alias("_t"), F.lit(0).alias("_kind"), seen.alias("_seen"))
    pcols = list(points.columns)
    p = points.select(*pcols, F.col(point_time).alias("_t"), F.lit(1).alias("_kind"))
    u = o.unionByName(p, allowMissingColumns=True)
    n = int(u.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = settled(u.repartitionByRange(n, key, "_t", "_kind", F.monotonically_increasing_id())
                  .withColumn("_slice", F.spark_partition_id()), "asof")
    before = Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = (cut.groupBy(key, "_slice").agg(F.max_by(F.when(F.col("_kind") == 0, F.col("_seen")), F.when(F.col("_kind") == 0, F.col("_t"))).alias("_end"))
              .select(F.col(key).alias("_s_key"), F.col("_slice").alias("_s_slice"), F.last("_end", ignorenulls=True).over(before).alias("_carried")))
    w = (Window.partitionBy(key, "_slice").orderBy("_t", "_kind")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    inside = cut.withColumn("_last", F.last("_seen", ignorenulls=True).over(w)).where(F.col("_kind") == 1)
    out = (inside.join(slices, F.col(key).eqNullSafe(F.col("_s_key")) & (F.col("_slice") == F.col("_s_slice")))
           .withColumn("_last", F.when(F.col("_t").isNotNull(), F.coalesce("_last", "_carried"))))
    return out.select(*pcols, F.col("_last.t").alias(f"asof_{obs_time}"),
                      *[F.col(f"_last.{v}").alias(f"asof_{v}") for v in values])


def brier(forecasts: DataFrame, by: list[str]) -> DataFrame:
    """Mean squared error of probability ``p`` against outcome ``y`` per group;
    ``n`` counts the rows that have both."""
    error = F.pow(F.col("p") - F.col("y"), 2)
    return forecasts.groupBy(*by).agg(F.count(error).alias("n"), F.avg(error).alias("brier"))


def query_contract(lines: DataFrame, num_queries: int = params.NUM_QUERIES,
                   max_words: int = params.MAX_QUERY_WORDS) -> DataFrame:
    """Per event: number of queries, longest query in words, any digit, and
    whether the answer kept the prompt's rules (exact count, fewer than
    ``max_words`` words, no digits)."""
    words = F.size(F.filter(F.split(F.col("query"), text.PY_SPACE + "+"), lambda s: s != ""))
    per = (lines.groupBy("event_ticker")
           .agg(F.count(F.lit(1)).alias("n_queries"), F.max(words).cast("bigint").alias("max_words"),
                F.bool_or(F.col("query").rlike("[0-9]")).alias("has_digit")))
    ok = ((F.col("n_queries") == num_queries) & (F.col("max_words") < max_words) & ~F.col("has_digit"))
    return per.withColumn("follows_rules", ok)

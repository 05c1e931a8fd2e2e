"""Many days of snapshots at once: presence episodes per ticker.

A ticker is present on a run day when that day's snapshot lists it. An
episode is a stretch of consecutive run days with the ticker present; it is
resolved on the first run day after its last day (none while it is still
present on the last run day). Frozen fields come from the first day of the
episode, quotes from the last.

Run days are one row per calendar day of the history -- a bounded table that
is broadcast. Per-ticker windows see at most one row per run day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def run_days(presence: DataFrame) -> DataFrame:
    """``day, run_no, next_run_day`` of every day some ticker was present."""
    days = presence.select("day").distinct()
    w = Window.orderBy("day")  # one row per calendar day
    return days.select("day", F.row_number().over(w).alias("run_no"),
                       F.lead("day").over(w).alias("next_run_day"))


def episodes(presence: DataFrame, key: str = "ticker", value: str | None = "price",
             first: tuple[str, ...] = (), last: tuple[str, ...] = ()) -> DataFrame:
    """``key, episode_no, first_day, last_day, n_days, resolved_on`` (gaps-and-islands
    over run days), with the fields ``first`` as of the first day and ``last`` as of
    the last one; ``value`` gives both, as ``first_<value>`` and ``last_<value>``."""
    days = F.broadcast(run_days(presence))
    p = presence.join(days.select("day", "run_no"), "day")
    w = Window.partitionBy(key).orderBy("day")
    island = F.col("run_no") - F.row_number().over(w)
    ends = []
    if value:
        ends += [F.min_by(value, "day").alias(f"first_{value}"), F.max_by(value, "day").alias(f"last_{value}")]
    ends += [F.min_by(c, "day").alias(c) for c in first] + [F.max_by(c, "day").alias(c) for c in last]
    eps = (p.withColumn("_island", island)
           .groupBy(key, "_island")
           .agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"),
                F.count(F.lit(1)).alias("n_days"), *ends))
    eps = eps.withColumn("episode_no", F.row_number().over(Window.partitionBy(key).orderBy("first_day")))
    return (eps.join(days.select(F.col("day").alias("last_day"), F.col("next_run_day").alias("resolved_on")),
                     "last_day")
            .drop("_island"))

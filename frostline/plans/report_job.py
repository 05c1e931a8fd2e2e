"""End-to-end report job: sample slice -> pending -> context report -> store."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frostline import params
from frostline.operators import context as cx
from frostline.operators import sampling as sm
from frostline.operators import search as se
from frostline.operators import similarity as si
from frostline.session import settled
from frostline.sources import state as stt


def build_reports(sample: DataFrame, details: DataFrame, search_results: DataFrame, pages: DataFrame,
                  outputs: DataFrame, stored: DataFrame, stamp: str, k: int | None = None,
                  batch_size: int = params.BATCH_SIZE, num_urls: int = params.NUM_URLS) -> dict[str, DataFrame]:
    """Context material for the sampled events still to report today.

    ``k`` selects the workflow slice ``[k, k + batch_size)`` of the sample by
    position; ``None`` processes every slice at once. Events without a
    detail record with markets are skipped. Returns ``reports`` (event_ticker,
    report), ``summary_prompts`` (what the model is asked per query line) and
    ``contents`` (the top articles behind each section).
    """
    chosen = sample if k is None else sm.batch(sample, k, batch_size)
    # tickers alone, read by several steps: written once, so that the planner knows their size
    todo = settled(cx.pending_events(chosen, stored, details, stamp).select("event_ticker"), "pending-events")
    mine = cx.with_markets(details.join(todo, "event_ticker", "left_semi"))
    desc = cx.descriptions(mine)
    lines = cx.query_lines(desc, outputs)
    results = search_results.join(todo, "event_ticker", "left_semi")
    dedup = se.dedup_results(results, num_urls)
    # the events to score are those with results: most markets needn't be moved to be described for that
    searched = settled(dedup.select("event_ticker").distinct(), "searched-events")
    described = settled(cx.descriptions(cx.with_markets(details.join(searched, "event_ticker", "left_semi"))), "descriptions")
    keys = settled(si.top_articles(si.score_links(described, dedup, pages), num_urls), "top-articles")
    top = si.with_texts(keys, dedup, pages)
    return {"reports": cx.reports(lines, outputs, desc),
            "summary_prompts": cx.summary_prompts(lines, desc, top),
            "contents": top}


def run_reports(spark: SparkSession, root: str, stamp: str, details: DataFrame, search_results: DataFrame,
                pages: DataFrame, outputs: DataFrame, k: int | None = None, run_key: str | None = None,
                **kwargs) -> dict[str, DataFrame]:
    """The report job on stored state: reads the day's stored sample (slice ``k``) and
    the stored reports, builds what is still missing and appends it. Returns the
    frames of ``build_reports``, whose ``contents`` are the articles per query in order."""
    sample = stt.read_day(spark, root, stt.SAMPLED_EVENTS, stamp)
    stored = stt.read_upto(spark, root, stt.REPORTS, stamp)
    made = build_reports(sample, details, search_results, pages, outputs, stored, stamp, k, **kwargs)
    store_reports(spark, root, made["reports"], stamp, run_key)
    return made


def store_reports(spark: SparkSession, root: str, new: DataFrame, stamp: str, run_key: str | None = None) -> None:
    """Append today's reports as new documents, numbered after any stored ones.

    Each document holds the key of the run that made it. A run that is repeated with its key, say after it broke
    while writing, skips what it has already stored: one document per event and run. Another run's report for the
    same event becomes a further document. Without a key the call is a run of its own.

    Appending only adds files, so the stored documents read here are never overwritten.
    """
    run_key = run_key or uuid.uuid4().hex
    stored = stt.read_upto(spark, root, stt.REPORTS, stamp).where(F.col("timestamp") == stamp)
    last = stored.groupBy("event_ticker").agg(F.max("doc_seq").alias("_last"), F.bool_or(F.col("run_key") == run_key).alias("_done"))
    docs = (new.join(last, "event_ticker", "left").where(~F.coalesce("_done", F.lit(False)))
            .select(F.lit(stamp).alias("timestamp"), "event_ticker", F.col("report").alias("ddgs_report"),
                    (F.coalesce("_last", F.lit(0)) + 1).cast("bigint").alias("doc_seq"), F.lit(run_key).alias("run_key")))
    stt.append_reports(docs, root)

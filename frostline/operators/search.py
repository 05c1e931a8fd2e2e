"""Search results -> deduplicated links -> fetched pages -> article text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frostline import params
from frostline.functions import text


def dedup_results(results: DataFrame, num_urls: int = params.NUM_URLS, since: str | None = None) -> DataFrame:
    """Keep the first ``2 * num_urls`` results of each query, drop empty links,
    then keep the first result per link inside one query (by rank).

    The rank limit comes first, so every (event, query, link) group holds at
    most ``2 * num_urls`` rows. ``since`` (``yyyy-MM-dd``) keeps only results
    whose ``published`` day is not before it, as a search limited to a year does.
    """
    if since is not None:
        results = results.where(F.col("published") >= F.lit(since).cast("date"))
        # ranks as the limited search would give them
        rank = Window.partitionBy("event_ticker", "query_no").orderBy("rnk")
        results = results.withColumn("rnk", F.row_number().over(rank).cast("bigint"))
    w = Window.partitionBy("event_ticker", "query_no", "href").orderBy("rnk")
    return (results.where(F.col("rnk") <= 2 * num_urls)
            .where(F.col("href").isNotNull() & (F.col("href") != ""))
            .withColumn("_first", F.row_number().over(w))
            .where(F.col("_first") == 1).drop("_first"))


def page_articles(pages: DataFrame, min_chars: int = params.ARTICLE_MIN_CHARS,
                  max_chars: int = params.ARTICLE_MAX_CHARS) -> DataFrame:
    """``url, article, n_chars`` for pages fetched with status 200 whose paragraph
    text has between ``min_chars`` and ``max_chars`` characters (inclusive)."""
    # The text is produced by a generator so that the length filter below
    # stays above it: the optimizer would otherwise inline the extraction into
    # the scan filter and evaluate it once per predicate.
    art = (pages.where(F.col("http_status") == 200)
           .select("url", F.explode(F.array(text.paragraph_text("html", most=max_chars))).alias("article")))
    return (art.withColumn("n_chars", F.length("article").cast("bigint"))
            .where(F.col("n_chars").between(min_chars, max_chars)))


def link_articles(links: DataFrame, pages: DataFrame, **bounds) -> DataFrame:
    """``href, article`` for every page that ``links`` (rows with ``href``) name and
    that yields an article. Each distinct page is parsed once, however many
    rows link to it."""
    needed = pages.join(links.select(F.col("href").alias("url")).distinct(), "url", "left_semi")
    return page_articles(needed, **bounds).select(F.col("url").alias("href"), "article")


def scrape(deduped: DataFrame, pages: DataFrame, **bounds) -> DataFrame:
    """Attach the article text to each deduplicated result; results whose page
    failed or is out of bounds are dropped."""
    return deduped.join(link_articles(deduped, pages, **bounds), "href")

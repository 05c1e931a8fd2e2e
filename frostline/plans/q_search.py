"""Queries over search results, fetched pages and article similarity."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from frostline import params
from frostline.operators import context as cx
from frostline.operators import search as se
from frostline.operators import similarity as si
from frostline.plans import sqlfrag as q
from frostline.plans.catalog import query
from frostline.session import settled
from frostline.sources import tables

C2 = repr((math.log(1.5) + 1.0) ** 2)


def described(spark, sf, events):
    """Descriptions of the events that ``events`` names, written once. Their tickers are a table of their own: while
    it is small, the planner sees so and leaves the market records where they are."""
    named = settled(events.select("event_ticker").distinct(), "linked-events")
    linked = tables.event_details(spark, sf).join(named, "event_ticker", "left_semi")
    return settled(cx.descriptions(cx.with_markets(linked)), "descriptions")


def results(spark, sf):
    """Deduplicated search results (keys of the bodies, no text) and the fetched pages."""
    return (se.dedup_results(tables.search_keys(spark, sf)),
            tables.standin(spark, sf, "fx_web_pages"))


def scored(spark, sf):
    dedup, pages = results(spark, sf)
    return si.score_links(described(spark, sf, dedup), dedup, pages)


# Oracle CTEs: dedup, articles, descriptions, similarity by the closed form.
_DEDUP = """
, lim AS (select * from fx_search_results where rnk <= 10 and href is not null and href <> '')
, dedup AS (select * from (select *, row_number() over (partition by event_ticker, query_no, href
                                                          order by rnk) as k from lim) z where k = 1)
"""
_ART = f"""
, pg AS (select url, html from fx_web_pages where http_status = 200)
{q.PARAGRAPHS}, art_ok AS (select url, article, cast(length(article) as bigint) as n_chars from art
             where length(article) between 200 and 100000)
"""
_SINGLE = q.fill(cx.SINGLE_MARKET, event_title="event_title", title="title", yes_sub_title="yes_sub_title",
                 rules_primary="rules_primary")
_ITEM = q.fill(cx.MARKET_ITEM, i="market_no", ticker="ticker", title="title", yes_sub_title="yes_sub_title",
               rules_primary="rules_primary")
_TAIL = ("(case when coalesce(rules_secondary, '') <> '' then "
         + q.fill(cx.SECONDARY_RULES, rules_secondary="rules_secondary") + " else '' end) || "
         + q.fill(cx.CLOSE_DATE, expiration_time="expiration_time"))
_DESC = f"""
, dm AS (select m.*, x.title as event_title from fx_feed_markets m
         join fx_details x on x.event_ticker = m.event_ticker)
, descs AS (
  select event_ticker, any_value(event_title) as event_title,
         case when count(*) = 1 then max(single) else string_agg(multi, '' order by market_no) end as description
  from (select event_ticker, event_title, market_no,
               {_SINGLE} || {_TAIL} as single,
               {_ITEM} || {_TAIL} || chr(10) as multi
        from dm) z
  group by event_ticker)
"""
_ALL_DESC = _DESC.replace("fx_details", "fx_all_details")
_SIM = _DEDUP + _ART + _DESC + f"""
, scraped AS (select d.*, a.article from dedup d join art_ok a on a.url = d.href
              where d.event_ticker in (select event_ticker from descs))
, dterm AS (select event_ticker, token, count(*) as tf
            from (select event_ticker, unnest({q.tokens('description')}) as token from descs) z
            group by event_ticker, token)
, aterm AS (select href, token, count(*) as tf
            from (select url as href, unnest({q.tokens('article')}) as token from art_ok
                  where url in (select href from scraped)) z
            group by href, token)
, pairs AS (select distinct event_ticker, href from scraped)
, dots AS (select p.event_ticker, p.href, sum(a.tf * d.tf) as dd, sum(a.tf * a.tf) as sa,
                  sum(d.tf * d.tf) as sb
           from pairs p join dterm d on d.event_ticker = p.event_ticker
           join aterm a on a.href = p.href and a.token = d.token
           group by p.event_ticker, p.href)
, na AS (select href, sum(tf * tf) as na from aterm group by href)
, nb AS (select event_ticker, sum(tf * tf) as nb from dterm group by event_ticker)
, sim AS (
  select event_ticker, href, case when den > 0 then dd / den else 0.0 end as similarity
  from (select p.event_ticker, p.href, coalesce(x.dd, 0) as dd,
               sqrt(coalesce(x.sa, 0) + (coalesce(na.na, 0) - coalesce(x.sa, 0)) * {C2})
               * sqrt(coalesce(x.sb, 0) + (coalesce(nb.nb, 0) - coalesce(x.sb, 0)) * {C2}) as den
        from pairs p left join dots x on x.event_ticker = p.event_ticker and x.href = p.href
        left join na on na.href = p.href left join nb on nb.event_ticker = p.event_ticker) z)
, scored AS (select s.*, m.similarity from scraped s
             join sim m on m.event_ticker = s.event_ticker and m.href = s.href)
, top AS (select * from (select *, row_number() over (partition by event_ticker, query_no
                                                        order by similarity desc, rnk) as article_no
                         from scored) z where article_no <= 5)
"""
SEARCH_BLOCKS = ("fx_search_results", "fx_web_pages", "fx_feed_markets", "fx_details", "fx_markets")


@query("search_dedup", blocks=("fx_search_results",), oracle=_DEDUP + """
select event_ticker, query_no, rnk, href from dedup
""")
def search_dedup(spark, sf):
    """First 2*num_urls results per query, empty links dropped, first per link."""
    return se.dedup_results(tables.search_keys(spark, sf)).select(
        "event_ticker", "query_no", "rnk", "href")


@query("search_recent", blocks=("fx_search_results",), oracle="""
, kept AS (select *, row_number() over (partition by event_ticker, query_no order by rnk) as r
           from fx_search_results where published >= date '2024-09-01')
select event_ticker, query_no, r as rnk, href, strftime(published, '%Y-%m-%d') as published
from (select *, row_number() over (partition by event_ticker, query_no, href order by r) as k from kept where r <= 10) z
where k = 1
""")
def search_recent(spark, sf):
    """Results of the last year only, ranked anew, first per link."""
    d = se.dedup_results(tables.search_keys(spark, sf), since="2024-09-01")
    return d.select("event_ticker", "query_no", "rnk", "href", F.date_format("published", "yyyy-MM-dd").alias("published"))


@query("page_articles", blocks=("fx_web_pages",), recursive=True, oracle=_ART + """
select url, article, n_chars from art_ok
""")
def page_articles(spark, sf):
    """Paragraph text of every fetched page (status 200, 200..100000 chars)."""
    return se.page_articles(tables.standin(spark, sf, "fx_web_pages"))


@query("term_counts", oracle=f"""
select doc_id, token, count(*) as tf
from (select doc_id, unnest({q.tokens('text')}) as token from documents) z
group by doc_id, token
""")
def term_counts(spark, sf):
    """Word-token counts of every document (whole texts)."""
    return si.term_counts(tables.table(spark, sf, "documents"), "doc_id", "text")


@query("pair_similarity", blocks=SEARCH_BLOCKS, recursive=True, oracle=_SIM + """
select event_ticker, query_no, rnk, href, round(similarity, 9) as similarity from scored
""")
def pair_similarity(spark, sf):
    """TF-IDF cosine of each scraped result against its event's description."""
    return scored(spark, sf).select("event_ticker", "query_no", "rnk", "href",
                                    F.round("similarity", 9).alias("similarity"))


@query("top_articles", blocks=SEARCH_BLOCKS, recursive=True, oracle=_SIM + """
select event_ticker, query_no, article_no, href, round(similarity, 9) as similarity from top
""")
def top_articles(spark, sf):
    """The num_urls most similar articles per query (ties in search order)."""
    top = si.top_articles(scored(spark, sf), params.NUM_URLS)
    return top.select("event_ticker", "query_no", F.col("article_no").cast("bigint").alias("article_no"),
                      "href", F.round("similarity", 9).alias("similarity"))

"""Queries over the context-report text: descriptions, prompts, sections."""

from __future__ import annotations

from pyspark.sql import functions as F

from frostline import params
from frostline.operators import context as cx
from frostline.operators import similarity as si
from frostline.plans import sqlfrag as q
from frostline.plans.catalog import query
from frostline.plans.q_search import _ALL_DESC, _DESC, _SIM, SEARCH_BLOCKS, results
from frostline.session import settled
from frostline.sources import tables

CTX_BLOCKS = SEARCH_BLOCKS + ("fx_model_outputs",)
ALL_CTX_BLOCKS = tuple("fx_all_details" if b == "fx_details" else b for b in CTX_BLOCKS)


def _outputs(spark, sf):
    return tables.standin(spark, sf, "fx_model_outputs")


def _ctx(spark, sf, detail_table=tables.event_details, write=False):
    """Described events the query model answered for, their query lines; ``write`` for descriptions that several
    steps read."""
    outputs = _outputs(spark, sf)
    # a table of tickers alone: while it is small, the planner sees so and leaves the market records where they are
    asked = settled(outputs.where(F.col("purpose") == "queries").select("event_ticker").distinct(), "asked-events")
    details = detail_table(spark, sf).join(asked, "event_ticker", "left_semi")
    desc = cx.descriptions(cx.with_markets(details))
    if write:
        desc = settled(desc, "descriptions")
    return desc, desc, cx.query_lines(desc, outputs), outputs


_QP = q.fill(cx.QUERY_PROMPT, event_title="event_title", descriptions="description",
             num_queries=str(params.NUM_QUERIES), max_words=str(params.MAX_QUERY_WORDS))
_ANS = f"""
, ans AS (select event_ticker, purpose, query_no, {q.strip("coalesce(completion, '')")} as answer
          from fx_model_outputs)
, ctx AS (select * from descs where event_ticker in
          (select event_ticker from fx_model_outputs where purpose = 'queries'))
, qlines AS (
  select event_ticker, unnest(l) as query, unnest(range(1, len(l) + 1)) as query_no
  from (select c.event_ticker, {q.lines('a.answer')} as l
        from ctx c join ans a on a.event_ticker = c.event_ticker and a.purpose = 'queries') z)
"""
_ARTICLE = q.fill(cx.ARTICLE_ITEM, i="article_no", title="title", body="body", href="href", article="article")
_SP = q.fill(cx.SUMMARY_PROMPT, event_title="event_title", descriptions="description",
             articles="coalesce(b.articles, '')")
_SECTION = q.fill(cx.SECTION, i="l.query_no", summary="s.answer")


@query("market_descriptions", blocks=("fx_feed_markets", "fx_all_details", "fx_markets"), oracle=_ALL_DESC + """
select event_ticker, description from descs
""")
def market_descriptions(spark, sf):
    """Readable description of each event's markets (one- and many-market forms)."""
    d = cx.descriptions(cx.with_markets(tables.all_event_details(spark, sf)))
    return d.select("event_ticker", "description")


@query("query_prompts", blocks=("fx_feed_markets", "fx_all_details", "fx_markets"), oracle=_ALL_DESC + f"""
select event_ticker, {_QP} as prompt from descs
""")
def query_prompts(spark, sf):
    """Search-query prompt of each described event."""
    d = cx.descriptions(cx.with_markets(tables.all_event_details(spark, sf)))
    return cx.query_prompts(d)


@query("query_lines", blocks=ALL_CTX_BLOCKS, oracle=_ALL_DESC + _ANS + """
select event_ticker, query_no, query from qlines
""")
def query_lines(spark, sf):
    """The model's search queries per event: non-blank trimmed lines, numbered."""
    _, _, lines, _ = _ctx(spark, sf, tables.all_event_details)
    return lines


@query("summary_prompts", blocks=CTX_BLOCKS, recursive=True, oracle=_SIM + _ANS + f"""
, blocks AS (select event_ticker, query_no, string_agg({_ARTICLE}, '' order by article_no) as articles
             from top group by event_ticker, query_no)
select l.event_ticker, l.query_no, {_SP} as prompt
from qlines l join descs d on d.event_ticker = l.event_ticker
left join blocks b on b.event_ticker = l.event_ticker and b.query_no = l.query_no
""")
def summary_prompts(spark, sf):
    """Summary prompt per query line with its top articles (none -> no blocks)."""
    desc, _, lines, _ = _ctx(spark, sf, write=True)
    dedup, pages = results(spark, sf)
    asked = dedup.join(desc.select("event_ticker"), "event_ticker", "left_semi")  # before any scoring
    # titles and body keys of the survivors, written once: their texts are read from there on
    ranked = si.top_articles(si.score_links(desc, asked, pages), params.NUM_URLS)
    top = settled(ranked.join(asked.select(*si.RESULT, "title", "body_id"), list(si.RESULT)), "top-articles")
    return cx.summary_prompts(lines, desc, si.with_texts(top, tables.search_bodies(spark, sf), pages, on=("body_id",)))


@query("context_report", blocks=ALL_CTX_BLOCKS, oracle=_ALL_DESC + _ANS + f"""
, secs AS (
  select l.event_ticker, string_agg({_SECTION}, chr(10) || chr(10) order by l.query_no) as r
  from qlines l left join ans s
    on s.event_ticker = l.event_ticker and s.purpose = 'summary' and s.query_no = l.query_no
  group by l.event_ticker)
select c.event_ticker, {q.strip("coalesce(s.r, '')")} as report
from ctx c left join secs s on s.event_ticker = c.event_ticker
""")
def context_report(spark, sf):
    """Final context report per event: numbered sections of summaries, trimmed."""
    _, events, lines, outputs = _ctx(spark, sf, tables.all_event_details)
    return cx.reports(lines, outputs, events)

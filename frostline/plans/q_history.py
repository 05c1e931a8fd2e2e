"""Queries over many days: lifecycle episodes and backtests."""

from __future__ import annotations

from pyspark.sql import functions as F

from frostline.operators import backtest as bt
from frostline.operators import context as cx
from frostline.operators import lifecycle as lc
from frostline.operators import reconcile as rc
from frostline.plans import sqlfrag as q
from frostline.plans.catalog import query
from frostline.plans.q_context import _ANS, ALL_CTX_BLOCKS, _ctx
from frostline.plans.q_reconcile import _MK, _MK_BLOCKS, day_state
from frostline.plans.q_search import _ALL_DESC
from frostline.sources import tables

HORIZON_DAYS = 7

_EPS = """
, days AS (select day, row_number() over (order by day) as run_no,
                  lead(day) over (order by day) as next_run_day
           from (select distinct day from fx_presence) z)
, pz AS (select f.*, d.run_no - row_number() over (partition by f.ticker order by f.day) as isl
         from fx_presence f join days d on d.day = f.day)
, eps0 AS (select ticker, isl, min(day) as first_day, max(day) as last_day, count(*) as n_days,
                  arg_min_null(price, day) as first_price, arg_max_null(price, day) as last_price
           from pz group by ticker, isl)
, eps AS (select e.*, row_number() over (partition by e.ticker order by e.first_day) as episode_no,
                 d.next_run_day as resolved_on
          from eps0 e join days d on d.day = e.last_day)
"""


def _episodes(spark, sf):
    return lc.episodes(tables.standin(spark, sf, "fx_presence"))


@query("ticker_episodes", blocks=("fx_presence",), oracle=_EPS + """
select ticker, episode_no, strftime(first_day, '%Y-%m-%d') as first_day,
       strftime(last_day, '%Y-%m-%d') as last_day, n_days,
       round(first_price, 9) as first_price, round(last_price, 9) as last_price,
       strftime(resolved_on, '%Y-%m-%d') as resolved_on
from eps
""")
def ticker_episodes(spark, sf):
    """Presence episodes per ticker over all snapshot days (gaps and islands)."""
    e = _episodes(spark, sf)
    return e.select("ticker", F.col("episode_no").cast("bigint").alias("episode_no"),
                    F.date_format("first_day", "yyyy-MM-dd").alias("first_day"),
                    F.date_format("last_day", "yyyy-MM-dd").alias("last_day"), "n_days",
                    F.round("first_price", 9).alias("first_price"),
                    F.round("last_price", 9).alias("last_price"),
                    F.date_format("resolved_on", "yyyy-MM-dd").alias("resolved_on"))


@query("asof_price", blocks=("fx_presence",), oracle=_EPS + f"""
, pts AS (select ticker, episode_no, resolved_on - {HORIZON_DAYS} as cutoff from eps where resolved_on is not null)
select p.ticker, p.episode_no, strftime(p.cutoff, '%Y-%m-%d') as cutoff,
       strftime(max(f.day), '%Y-%m-%d') as asof_day, round(arg_max_null(f.price, f.day), 9) as asof_price
from pts p left join fx_presence f on f.ticker = p.ticker and f.day <= p.cutoff
group by p.ticker, p.episode_no, p.cutoff
""")
def asof_price(spark, sf):
    """Price of each resolved episode's ticker as of 7 days before resolution."""
    pres = tables.standin(spark, sf, "fx_presence")
    pts = (_episodes(spark, sf).where(F.col("resolved_on").isNotNull())
           .select("ticker", F.col("episode_no").cast("bigint").alias("episode_no"),
                   F.date_sub("resolved_on", HORIZON_DAYS).alias("cutoff")))
    a = bt.asof(pres, pts, "ticker", "day", "cutoff", ["price"])
    return a.select("ticker", "episode_no", F.date_format("cutoff", "yyyy-MM-dd").alias("cutoff"),
                    F.date_format("asof_day", "yyyy-MM-dd").alias("asof_day"),
                    F.round("asof_price", 9).alias("asof_price"))


@query("asof_context", blocks=("fx_report_events", "fx_report_days"), oracle="""
, pts AS (select event_ticker, resolved_on from fx_report_events)
select p.event_ticker, strftime(p.resolved_on, '%Y-%m-%d') as resolved_on, max(r.stamp) as context_stamp,
       arg_max(r.hash_id, r.stamp) as report_id,
       cast(date_diff('day', strptime(max(r.stamp), '%Y%m%d')::date, p.resolved_on) as bigint) as days_before
from pts p left join fx_report_days r on r.event_ticker = p.event_ticker and r.stamp < strftime(p.resolved_on, '%Y%m%d')
group by p.event_ticker, p.resolved_on
""")
def asof_context(spark, sf):
    """The latest stored report of an event strictly before its resolution, from the
    event's report index (a map of day stamps to report ids)."""
    events = tables.reported_events(spark, sf)
    entries = events.select("event_ticker", F.explode("ddgs_reports").alias("stamp", "report_id"))
    pts = events.select("event_ticker", "resolved_on",
                        F.date_format(F.date_sub("resolved_on", 1), "yyyyMMdd").alias("_before"))
    a = bt.asof(entries, pts, "event_ticker", "stamp", "_before", ["report_id"])
    return a.select("event_ticker", F.date_format("resolved_on", "yyyy-MM-dd").alias("resolved_on"),
                    F.col("asof_stamp").alias("context_stamp"), F.col("asof_report_id").alias("report_id"),
                    F.datediff("resolved_on", F.to_date("asof_stamp", "yyyyMMdd")).cast("bigint").alias("days_before"))


@query("strategy_score", blocks=_MK_BLOCKS + ("fx_prev_events", "fx_all_details"), oracle=_MK + """
, res AS (select p.* from first_prev p where p.ticker not in (select ticker from act))
, outcome AS (select r.ticker, e.category, case when m.result = 'yes' then 1.0 else 0.0 end as y,
                     r.prev_price as p_last
              from res r join fx_markets m on m.ticker = r.ticker
              join fx_all_details x on x.event_ticker = m.event_ticker
              join fx_prev_events e on e.event_ticker = r.event_ticker
              where m.result in ('yes', 'no'))
, fc AS (select 'last_price' as strategy, category, p_last as p, y from outcome
         union all select 'coin' as strategy, category, 0.5 as p, y from outcome)
select strategy, category, count(*) as n, round(avg((p - y) * (p - y)), 9) as brier
from fc group by strategy, category
""")
def strategy_score(spark, sf):
    """Brier score by strategy and category over markets resolved today with a
    decided result: last stored price against a coin flip."""
    s = day_state(spark, sf)
    last = F.element_at(F.array_sort(F.map_entries("market_price")), -1)["value"]
    gone = s["resolved_markets_new"].select("ticker", "event_ticker", last.alias("p_last"), "state_pos")
    res = rc.first_stored(gone, ("event_ticker", "p_last"))
    # a result is met by its market's ticker alone, so the resolved markets aren't worked out a second time to name their events
    results = (tables.all_event_details(spark, sf)
               .select(F.explode(cx.market_fields(("ticker", "result"))).alias("m")).select("m.*")
               .where(F.col("result").isin("yes", "no")))
    cats = tables.previous_events(spark, sf).select("event_ticker", "category")
    out = (res.join(results, "ticker").join(cats, "event_ticker")
           .withColumn("y", F.when(F.col("result") == "yes", 1.0).otherwise(0.0)))
    told = lambda name, p: F.struct(F.lit(name).alias("strategy"), p.alias("p"))
    fc = (out.select("category", "y", F.explode(F.array(told("last_price", F.col("p_last")), told("coin", F.lit(0.5)))).alias("f"))
          .select("category", "y", "f.*"))
    return bt.brier(fc, ["strategy", "category"]).withColumn("brier", F.round("brier", 9))


_WORDS = f"len(list_filter(string_split_regex(query, '{q.text.PY_SPACE}+'), lambda s: s <> ''))"


@query("query_contract", blocks=ALL_CTX_BLOCKS, oracle=_ALL_DESC + _ANS + f"""
select event_ticker, count(*) as n_queries, cast(max({_WORDS}) as bigint) as max_words,
       bool_or(regexp_matches(query, '[0-9]')) as has_digit,
       count(*) = 6 and max({_WORDS}) < 7 and not bool_or(regexp_matches(query, '[0-9]')) as follows_rules
from qlines group by event_ticker
""")
def query_contract(spark, sf):
    """Did the model's query list keep the prompt's rules (count, words, digits)?"""
    _, _, lines, _ = _ctx(spark, sf, tables.all_event_details)
    return bt.query_contract(lines)

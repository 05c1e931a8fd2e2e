"""Queries over one day of the snapshot reconcile (events, markets, index)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frostline import schemas
from frostline.operators import reconcile as rc
from frostline.plans.catalog import query
from frostline.sources import standins as st
from frostline.sources import tables

DAY = st.STAMP_TODAY


def _inputs(spark: SparkSession, sf: str):
    return dict(feed=tables.current_feed(spark, sf), details=tables.event_details(spark, sf),
                prev_events=tables.previous_events(spark, sf),
                prev_markets=tables.previous_markets(spark, sf), reports=tables.reports(spark, sf))


_DAY_PLANS: dict[tuple, dict[str, DataFrame]] = {}


def day_state(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """The day's reconcile frames (plans only; built once per session and folder)."""
    key = (tables.session_key(spark), sf)
    if key not in _DAY_PLANS:
        for old in [k for k in _DAY_PLANS if k[0] != key[0]]:  # plans of stopped sessions
            del _DAY_PLANS[old]
        _DAY_PLANS[key] = rc.reconcile(stamp=DAY, **_inputs(spark, sf))
    return _DAY_PLANS[key]


def _valid_and_prev(spark, sf):
    valid, _ = rc.split_feed(tables.current_feed(spark, sf))
    return valid, tables.previous_events(spark, sf)


# Shared oracle CTEs: valid feed events, dropped events with detail aggregates.
_CUR = """
, cur AS (
  select e.* from fx_feed_events e
  left join (select event_ticker, count(*) as n from fx_feed_markets group by event_ticker) c
    on c.event_ticker = e.event_ticker
  where coalesce(c.n, 0) < 6)
"""
_DROPPED = _CUR + """
, dropped AS (select * from fx_prev_events where event_ticker not in (select event_ticker from cur))
, magg AS (
  select event_ticker, min(case when l_orderkey % 101 <> 50 then open_time end) as eo, max(close_time) as lc,
         bool_and(status not in ('active', 'initialized')) as is_resolved,
         bool_or(status not in ('active', 'initialized') and result in ('yes', 'no')) as has_resolved
  from fx_markets group by event_ticker)
, resolved AS (
  select d.*, strftime(a.lc, '%Y-%m-%d') as resolution_date, a.is_resolved, a.has_resolved,
         strftime(a.eo, '%Y-%m-%d') as earliest_open_time, coalesce(x.category, 'Uncategorized') as detail_category
  from dropped d join fx_details x on x.event_ticker = d.event_ticker
  join magg a on a.event_ticker = d.event_ticker and a.eo is not null)
"""
_EV_BLOCKS = ("fx_feed_events", "fx_feed_markets", "fx_prev_events", "fx_details", "fx_markets")


@query("event_lifecycle", blocks=_EV_BLOCKS, oracle=_CUR + """
select coalesce(p.event_ticker, c.event_ticker) as event_ticker,
       case when p.event_ticker is not null and c.event_ticker is not null then 'retained'
            when p.event_ticker is not null then 'dropped' else 'new' end as lifecycle
from fx_prev_events p full outer join cur c on p.event_ticker = c.event_ticker
""")
def event_lifecycle(spark, sf):
    """Retained / dropped / new classification of every stored or feed event."""
    valid, prev = _valid_and_prev(spark, sf)
    return rc.classify_events(prev, valid)


@query("event_resolution", blocks=_EV_BLOCKS, oracle=_DROPPED + """
select event_ticker, resolution_date, resolution_date as latest_close_time, earliest_open_time,
       detail_category as category, is_resolved, has_resolved
from resolved
""")
def event_resolution(spark, sf):
    """Resolution facts of the dropped events (detail join + per-event aggregates)."""
    valid, prev = _valid_and_prev(spark, sf)
    res, _ = rc.resolve_dropped(rc.dropped_events(prev, valid), tables.event_details(spark, sf))
    return res.select("event_ticker", "resolution_date", "latest_close_time", "earliest_open_time",
                      "category", "is_resolved", "has_resolved")


@query("event_quarantine", blocks=_EV_BLOCKS, oracle=_DROPPED + """
select d.event_ticker,
       case when x.event_ticker is null then 'detail_missing' when a.event_ticker is null then 'no_markets' else 'no_times' end as reason
from dropped d left join fx_details x on x.event_ticker = d.event_ticker
left join magg a on a.event_ticker = d.event_ticker
where x.event_ticker is null or a.eo is null
""")
def event_quarantine(spark, sf):
    """Events that cannot be placed: no detail, no markets, no times."""
    return day_state(spark, sf)["quarantine"]


@query("events_retained", blocks=_EV_BLOCKS + ("fx_prev_event_reports",), oracle=_CUR + """
select p.event_ticker, p.series_ticker, p.title, p.sub_title, p.mutually_exclusive, p.category, p.added_on, p.feed_pos,
       coalesce(r.entries, '') as reports
from fx_prev_events p
left join (select event_ticker, string_agg(stamp || '=' || hash_id, ',' order by stamp) as entries
           from fx_prev_event_reports group by event_ticker) r on r.event_ticker = p.event_ticker
where p.event_ticker in (select event_ticker from cur)
""")
def events_retained(spark, sf):
    """Stored events still on the feed, with all their fields and report entries."""
    valid, prev = _valid_and_prev(spark, sf)
    entries = F.transform(F.array_sort(F.map_entries("ddgs_reports")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return rc.retained_events(prev, valid).select(*rc.EVENT_FIELDS, "added_on", "feed_pos",
                                                  F.array_join(entries, ",").alias("reports"))


@query("events_dropped", blocks=_EV_BLOCKS, oracle=_CUR + """
select event_ticker, title, category, added_on, feed_pos
from fx_prev_events where event_ticker not in (select event_ticker from cur)
""")
def events_dropped(spark, sf):
    valid, prev = _valid_and_prev(spark, sf)
    return rc.dropped_events(prev, valid).select("event_ticker", "title", "category", "added_on", "feed_pos")


@query("events_new", blocks=_EV_BLOCKS, oracle=_CUR + """
select event_ticker, series_ticker, title, sub_title, mutually_exclusive, category,
       '20250901' as added_on, feed_pos
from cur where event_ticker not in (select event_ticker from fx_prev_events)
""")
def events_new(spark, sf):
    valid, prev = _valid_and_prev(spark, sf)
    return rc.new_events(prev, valid, DAY).select("event_ticker", "series_ticker", "title", "sub_title",
                                                  "mutually_exclusive", "category", "added_on", "feed_pos")


_INDEX = _DROPPED + """
, first_doc AS (
  select timestamp, event_ticker, ddgs_report from (
    select *, row_number() over (partition by timestamp, event_ticker order by doc_seq) as rn
    from fx_reports) z where rn = 1)
, found AS (select event_ticker, timestamp as stamp from first_doc
            where ddgs_report is not null and timestamp = '20250901')
, placed AS (
  select event_ticker, 'active' as scope from fx_prev_events
    where event_ticker in (select event_ticker from cur)
  union all
  select event_ticker, 'active' as scope from cur
    where event_ticker not in (select event_ticker from fx_prev_events)
  union all
  select event_ticker, 'resolved' as scope from resolved)
, entries AS (
  select p.event_ticker, p.scope, r.stamp, r.hash_id
  from placed p join fx_prev_event_reports r on r.event_ticker = p.event_ticker
  union all
  select p.event_ticker, p.scope, f.stamp, concat('ddgs_', lower(p.event_ticker), '_', f.stamp) as hash_id
  from placed p join found f on f.event_ticker = p.event_ticker
  where not exists (select 1 from fx_prev_event_reports r
                    where r.event_ticker = p.event_ticker and r.stamp = f.stamp))
"""
_IDX_BLOCKS = _EV_BLOCKS + ("fx_reports", "fx_prev_event_reports")


@query("report_index", blocks=_IDX_BLOCKS, oracle=_INDEX + """
select event_ticker, scope, stamp, hash_id from entries
""")
def report_index(spark, sf):
    """Report-index entries (long form of ``ddgs_reports``) of active and newly resolved events."""
    s = day_state(spark, sf)
    act = s["active_events"].select("event_ticker", F.lit("active").alias("scope"), "ddgs_reports")
    res = s["resolved_events_new"].select("event_ticker", F.lit("resolved").alias("scope"), "ddgs_reports")
    return (act.unionByName(res)
            .select("event_ticker", "scope", F.explode("ddgs_reports").alias("stamp", "hash_id")))


@query("active_events", blocks=_IDX_BLOCKS, oracle=_INDEX + """
, act AS (
  select event_ticker, series_ticker, title, sub_title, mutually_exclusive, category, added_on, feed_pos
  from fx_prev_events where event_ticker in (select event_ticker from cur)
  union all
  select event_ticker, series_ticker, title, sub_title, mutually_exclusive, category,
         '20250901' as added_on, feed_pos
  from cur where event_ticker not in (select event_ticker from fx_prev_events))
select a.*, coalesce(e.days, '') as report_days
from act a left join (select event_ticker, string_agg(stamp, ',' order by stamp) as days
                      from entries where scope = 'active' group by event_ticker) e
  on e.event_ticker = a.event_ticker
""")
def active_events(spark, sf):
    """Active-event state after the day: retained (stored row) + new records."""
    ev = day_state(spark, sf)["active_events"]
    return ev.select("event_ticker", "series_ticker", "title", "sub_title", "mutually_exclusive",
                     "category", "added_on", "feed_pos",
                     F.array_join(F.array_sort(F.map_keys("ddgs_reports")), ",").alias("report_days"))


_MK = _CUR + """
, act AS (select m.*, c.feed_pos,
                 case when m.yes_bid is null or m.no_bid is null then null
                      when m.yes_bid + m.no_bid > 0 then m.yes_bid / (m.yes_bid + m.no_bid)
                      else m.last_price / 100 end as price
          from fx_feed_markets m join cur c on c.event_ticker = m.event_ticker
          where m.status = 'active')
, first_prev AS (
  select * from (select *, row_number() over (partition by ticker order by state_pos) as rn
                 from fx_prev_markets) z where rn = 1)
"""
_MK_BLOCKS = ("fx_feed_events", "fx_feed_markets", "fx_prev_markets", "fx_markets")


@query("market_price", blocks=("fx_all_events", "fx_feed_markets"), oracle="""
select ticker, event_ticker,
       round(case when yes_bid is null or no_bid is null then null when yes_bid + no_bid > 0 then yes_bid / (yes_bid + no_bid)
                  else last_price / 100 end, 9) as market_price
from fx_feed_markets
where status = 'active'
  and event_ticker in (select event_ticker from fx_feed_markets group by event_ticker having count(*) < 6)
""")
def market_price(spark, sf):
    """Implied price of every active market of all events within the market limit, whenever they were placed."""
    valid, _ = rc.split_feed(tables.all_events_feed(spark, sf))
    return rc.active_markets_today(valid, ("ticker", "event_ticker")).select("ticker", "event_ticker",
                                                 F.round("price", 9).alias("market_price"))


# Market fields by kind; quotes are compared as doubles, as absent ones have no integer form.
_TEXTS = [f for f in schemas.MARKET_STATE_FIELDS if f not in schemas.QUOTE_FIELDS]


def _market_columns():
    return [*_TEXTS, *[F.col(c).cast("double").alias(c) for c in schemas.QUOTE_FIELDS]]


@query("markets_new", blocks=_MK_BLOCKS, oracle=_MK + f"""
select {", ".join(f"coalesce({c}, '') as {c}" for c in _TEXTS)},
       {", ".join(f"cast({c} as double) as {c}" for c in schemas.QUOTE_FIELDS)},
       round(price, 9) as price, cast(feed_pos * 6 + market_no - 1 as bigint) as state_pos
from act where ticker not in (select ticker from fx_prev_markets)
""")
def markets_new(spark, sf):
    """Markets active today and never stored, as new records with all fields."""
    valid, _ = rc.split_feed(tables.current_feed(spark, sf))
    m = rc.new_markets(rc.active_markets_today(valid), tables.previous_markets(spark, sf), DAY)
    return m.select(*_market_columns(), F.round(F.col("market_price")[DAY], 9).alias("price"), "state_pos")


@query("markets_refreshed", blocks=_MK_BLOCKS, oracle=_MK + f"""
select {", ".join(f"p.{c}" for c in _TEXTS)},
       {", ".join(f"cast(coalesce(a.{c}, p.{c}) as double) as {c}" for c in schemas.QUOTE_FIELDS)},
       round(p.prev_price, 9) as price_prev, round(a.price, 9) as price_today,
       cast(a.feed_pos * 6 + a.market_no - 1 as bigint) as state_pos
from act a join first_prev p on p.ticker = a.ticker
""")
def markets_refreshed(spark, sf):
    """Known active markets: the first stored record with today's quotes and price."""
    valid, _ = rc.split_feed(tables.current_feed(spark, sf))
    m = rc.refreshed_markets(rc.active_markets_today(valid), tables.previous_markets(spark, sf), DAY)
    return m.select(*_market_columns(), F.round(F.col("market_price")[st.STAMP_PREV], 9).alias("price_prev"),
                    F.round(F.col("market_price")[DAY], 9).alias("price_today"), "state_pos")


@query("markets_resolved", blocks=_MK_BLOCKS, oracle=_MK + """
select ticker, event_ticker, state_pos, '20250901' as resolution_date
from fx_prev_markets where ticker not in (select ticker from act)
""")
def markets_resolved(spark, sf):
    """Every stored market record (copies kept) that is no longer active."""
    return day_state(spark, sf)["resolved_markets_new"].select("ticker", "event_ticker", "state_pos",
                                                                "resolution_date")


@query("price_series", blocks=_MK_BLOCKS, oracle=_MK + """
select ticker, '20250901' as stamp, round(price, 9) as price from act
union all
select a.ticker, '20250831' as stamp, round(p.prev_price, 9) as price
from act a join first_prev p on p.ticker = a.ticker
""")
def price_series(spark, sf):
    """Dated price series of the active markets (map in long form)."""
    m = day_state(spark, sf)["active_markets"]
    return (m.select("ticker", F.explode("market_price").alias("stamp", "price"))
            .withColumn("price", F.round("price", 9)))

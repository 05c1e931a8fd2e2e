"""Queries over what the jobs leave in stored state: a published day, its counts, stored reports."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from frostline.functions import dates
from frostline.operators import reconcile as rc
from frostline.operators import sampling as sm
from frostline.plans import daily, report_job
from frostline.plans import sqlfrag as q
from frostline.plans.catalog import query
from frostline.plans.q_context import _ANS, _SECTION, CTX_BLOCKS
from frostline.plans.q_reconcile import _CUR, _DROPPED, _EV_BLOCKS, _IDX_BLOCKS, DAY, day_state
from frostline.plans.q_search import _DESC
from frostline.session import checkpoint_dir
from frostline.sources import standins as st
from frostline.sources import state as stt
from frostline.sources import tables

LOOKBACK = dates.lookback_stamps(st.TODAY, 3)
_DAYS = ", ".join(f"'{d}'" for d in LOOKBACK)


@query("report_index_lookback", blocks=_IDX_BLOCKS, oracle=_DROPPED + f"""
, found AS (
  select event_ticker, timestamp as stamp from (
    select *, row_number() over (partition by timestamp, event_ticker order by doc_seq) as rn from fx_reports) z
  where rn = 1 and ddgs_report is not null and timestamp in ({_DAYS}))
, placed AS (
  select event_ticker, 'active' as scope, false as fresh from fx_prev_events where event_ticker in (select event_ticker from cur)
  union all
  select event_ticker, 'active' as scope, true as fresh from cur where event_ticker not in (select event_ticker from fx_prev_events)
  union all
  select event_ticker, 'resolved' as scope, false as fresh from resolved)
select p.event_ticker, p.scope, r.stamp, r.hash_id
from placed p join fx_prev_event_reports r on r.event_ticker = p.event_ticker
union
select p.event_ticker, p.scope, f.stamp, concat('ddgs_', lower(p.event_ticker), '_', f.stamp)
from placed p join found f on f.event_ticker = p.event_ticker
where not p.fresh or f.stamp = '{DAY}'
""")
def report_index_lookback(spark, sf):
    """Report-index entries of active and newly resolved events where the job looks back three days; a new
    event takes today's only. All from the one-pass reconcile."""
    events = rc.classified_events(tables.current_feed(spark, sf), tables.event_details(spark, sf), tables.previous_events(spark, sf),
                                  tables.reports(spark, sf), DAY, LOOKBACK)
    return (events.where(F.col("scope") != "quarantine")
            .select("event_ticker", "scope", F.explode("ddgs_reports").alias("stamp", "hash_id")))


@query("day_counts", blocks=_EV_BLOCKS + ("fx_prev_markets",), oracle=_DROPPED + """
, active AS (select count(*) as n from cur)
, mk AS (select m.ticker from fx_feed_markets m join cur on cur.event_ticker = m.event_ticker where m.status = 'active')
select 'active_events' as name, n from active
union all
select 'sampled_events' as name, least(210, n) from active
union all
select 'resolved_events' as name, count(*) from resolved
union all
select 'quarantine' as name, count(*) from dropped where event_ticker not in (select event_ticker from resolved)
union all
select 'active_markets' as name, count(*) from mk
union all
select 'resolved_markets' as name, count(*) from fx_prev_markets where ticker not in (select ticker from mk)
""")
def day_counts(spark, sf):
    """Rows of each table as a day's run counts them while it publishes the day on imported state."""
    root = f"{checkpoint_dir(spark)}/day-{uuid.uuid4().hex}"
    stt.write_day(spark, root, st.STAMP_PREV, {stt.ACTIVE_EVENTS: tables.previous_events(spark, sf),
                                               stt.ACTIVE_MARKETS: tables.previous_markets(spark, sf)})
    counts = daily.run_day(spark, root, tables.current_feed(spark, sf), tables.event_details(spark, sf), tables.reports(spark, sf), DAY,
                           lookback=LOOKBACK)
    return spark.createDataFrame(sorted(counts.items()), "name string, n bigint")


@query("stored_reports", blocks=CTX_BLOCKS + _EV_BLOCKS + ("fx_reports",), oracle=_CUR + _DESC + _ANS + f"""
, secs AS (
  select l.event_ticker, string_agg({_SECTION}, chr(10) || chr(10) order by l.query_no) as r
  from qlines l left join ans s
    on s.event_ticker = l.event_ticker and s.purpose = 'summary' and s.query_no = l.query_no
  group by l.event_ticker)
, today AS (select *, row_number() over (partition by event_ticker order by doc_seq) as rn from fx_reports where timestamp = '{DAY}')
, todo AS (
  select event_ticker from cur
  where event_ticker not in (select event_ticker from today where rn = 1 and ddgs_report is not null and ddgs_report <> '')
    and event_ticker in (select event_ticker from fx_details) and event_ticker in (select event_ticker from fx_markets))
select event_ticker, doc_seq, ddgs_report as report from today
union all
select t.event_ticker, coalesce(m.k, 0) + 1 as doc_seq, {q.strip("coalesce(s.r, '')")} as report
from todo t left join secs s on s.event_ticker = t.event_ticker
left join (select event_ticker, max(doc_seq) as k from today group by event_ticker) m on m.event_ticker = t.event_ticker
""")
def stored_reports(spark, sf):
    """Today's report documents after the report job ran over the stored sample (all events here) and was
    repeated with its run key: what was stored before, and one new document for each event that lacked a report."""
    root = f"{checkpoint_dir(spark)}/reports-{uuid.uuid4().hex}"
    sample = sm.stratified_sample(day_state(spark, sf)["active_events"], target=2 ** 31)
    stt.write_day(spark, root, DAY, {stt.SAMPLED_EVENTS: sample.drop("order_key")})
    stt.append_reports(tables.reports(spark, sf).withColumn("run_key", F.lit(None).cast("string")), root)
    for _ in range(2):
        report_job.run_reports(spark, root, DAY, tables.event_details(spark, sf), tables.standin(spark, sf, "fx_search_results"),
                               tables.standin(spark, sf, "fx_web_pages"), tables.standin(spark, sf, "fx_model_outputs"), run_key="daily")
    docs = stt.read_upto(spark, root, stt.REPORTS, DAY).where(F.col("timestamp") == DAY)
    return docs.select("event_ticker", "doc_seq", F.col("ddgs_report").alias("report"))

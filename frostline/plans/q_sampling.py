"""Queries over the daily stratified sample and the report work list."""

from __future__ import annotations

from pyspark.sql import functions as F

from frostline import params
from frostline.operators import sampling as sm
from frostline.plans.catalog import query
from frostline.plans.q_reconcile import _CUR, _EV_BLOCKS, day_state
from frostline.sources import standins as st
from frostline.sources import tables

_BLOCKS = _EV_BLOCKS + ("fx_reports",)

# Oracle: quotas by a recursive CTE stepping through the sorted strata one at a time.
_Q = _CUR + """
, act AS (
  select event_ticker, category, added_on, feed_pos from fx_prev_events
    where event_ticker in (select event_ticker from cur)
  union all
  select event_ticker, category, '20250901' as added_on, feed_pos from cur
    where event_ticker not in (select event_ticker from fx_prev_events))
, act2 AS (select *, row_number() over (order by added_on, feed_pos) as lpos from act)
, strata AS (select category, count(*) as n, min(lpos) as first_pos from act2 group by category)
, ordered AS (select *, row_number() over (order by n, first_pos, category) as i,
                      count(*) over () as c from strata)
, rec AS (
  select cast(0 as bigint) as i, cast(210 as bigint) as rem, cast(0 as bigint) as take
  union all
  select o.i,
         r.rem - least(o.n, cast(greatest(1, floor(r.rem / (o.c - o.i + 1))) as bigint)) as rem,
         least(o.n, cast(greatest(1, floor(r.rem / (o.c - o.i + 1))) as bigint)) as take
  from rec r join ordered o on o.i = r.i + 1)
, quota AS (select o.category, o.n, o.i - 1 as stratum_no, r.take as quota
            from ordered o join rec r on r.i = o.i)
, picked AS (
  select a.*, q.quota, q.n, q.stratum_no,
         row_number() over (partition by a.category
                            order by md5(concat('37:', a.event_ticker)), a.event_ticker) as rn
  from act2 a join quota q on q.category is not distinct from a.category)
, sample AS (
  select event_ticker, category,
         row_number() over (order by stratum_no, case when quota = n then lpos else rn end) - 1 as position
  from picked where rn <= quota)
"""


def _keys(spark, sf):
    return sm.sample_keys(day_state(spark, sf)["active_events"])


@query("sample_quotas", blocks=_BLOCKS, recursive=True, oracle=_Q + """
select category, n as n_events, stratum_no, quota from quota
""")
def sample_quotas(spark, sf):
    """Stratum quotas of the daily sample (target 210)."""
    q = sm.quotas(sm.strata(_keys(spark, sf)), params.SAMPLE_TARGET)
    return q.select("category", F.col("n").alias("n_events"), "stratum_no", "quota")


@query("stratified_sample", blocks=_BLOCKS, recursive=True, oracle=_Q + """
select event_ticker, category, position from sample
""")
def stratified_sample(spark, sf):
    """The daily sample of active events with its stored position."""
    return sm.draw(_keys(spark, sf)).select("event_ticker", "category", "position")


@query("short_list_sample", blocks=_BLOCKS, recursive=True, oracle=_Q + """
select event_ticker, category, lpos - 1 as position from act2
""")
def short_list_sample(spark, sf):
    """The sample where the list is no longer than the target: the list itself."""
    return sm.draw(_keys(spark, sf), target=2 ** 31).select("event_ticker", "category", "position")


@query("sample_report", blocks=_BLOCKS, recursive=True, oracle=_Q + """
select s.category, s.n as original, coalesce(c.k, 0) as sampled
from strata s left join (select category, count(*) as k from sample group by category) c
  on c.category is not distinct from s.category
""")
def sample_report(spark, sf):
    """Original and sampled counts per category."""
    keys = _keys(spark, sf)
    return sm.sample_report(keys, sm.draw(keys))


@query("sample_batch", blocks=_BLOCKS, recursive=True, oracle=_Q + """
select event_ticker, category, position from sample where position >= 70 and position < 140
""")
def sample_batch(spark, sf):
    """The second workflow's slice of the sample: positions [70, 140)."""
    return sm.batch(sm.draw(_keys(spark, sf)), 70).select("event_ticker", "category", "position")


@query("events_pending", blocks=_BLOCKS, recursive=True, oracle=_Q + """
, first_doc AS (
  select timestamp, event_ticker, ddgs_report from (
    select *, row_number() over (partition by timestamp, event_ticker order by doc_seq) as rn
    from fx_reports) z where rn = 1)
select s.event_ticker, s.position, cast(floor(s.position / 70) as bigint) as batch_no
from sample s
where not exists (select 1 from first_doc f
                  where f.event_ticker = s.event_ticker and f.timestamp = '20250901'
                    and f.ddgs_report <> '')
  and s.event_ticker in (select event_ticker from fx_details)
  and s.event_ticker in (select event_ticker from fx_markets)
""")
def events_pending(spark, sf):
    """Report work list: sampled events without a non-empty report today whose
    detail has markets, with the workflow slice they fall in."""
    from frostline.operators import context as cx
    sample = sm.draw(_keys(spark, sf))
    todo = cx.pending_events(sample, tables.reports(spark, sf), tables.event_details(spark, sf),
                             st.STAMP_TODAY)
    return todo.select("event_ticker", "position",
                       F.floor(F.col("position") / params.BATCH_SIZE).cast("bigint").alias("batch_no"))

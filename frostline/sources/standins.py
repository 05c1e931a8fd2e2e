"""Stand-in input tables derived from the driver's parquet tables.

The original jobs read a market API, a document store, a web search service,
web pages and a language model. Here those inputs are frozen tables. Each block
below only renames and reshapes driver rows into the schema a job expects; it
does none of the job's work. Every block is plain SQL that runs unchanged in
Spark SQL and DuckDB, so the SQL oracle can rebuild the very same inputs.

Blocks are listed in dependency order.
"""

from __future__ import annotations

# Day of the snapshot the stand-ins describe, and the two days before it.
TODAY = "2025-09-01"
STAMP_TODAY = "20250901"
STAMP_PREV = "20250831"
STAMP_PREV2 = "20250830"
# Day of the oldest order on today's feed, as ``fx_feed_events`` has it.
FEED_SINCE = "1996-06-01"
# Day before which the orders of yesterday's state were placed, as ``fx_prev_markets`` has it.
PREV_UNTIL = "2000-06-01"

BLOCKS: dict[str, str] = {}

# One market per line item; the order is its event.
BLOCKS["fx_markets"] = """
select concat('O', cast(l_orderkey as string), '-M', cast(market_no as string)) as ticker,
       concat('O', cast(l_orderkey as string)) as event_ticker,
       l_orderkey, market_no, o_orderdate,
       case when l_linestatus = 'O' and l_returnflag = 'N' then 'initialized'
            when l_linestatus = 'O' then 'active'
            when l_returnflag = 'N' then 'closed' else 'finalized' end as status,
       case when l_linestatus = 'F' and l_returnflag = 'R' then 'yes'
            when l_linestatus = 'F' and l_returnflag = 'A' then 'no' else '' end as result,
       least(o_orderdate, l_shipdate) as open_time,
       greatest(o_orderdate, l_shipdate) as close_time,
       case when l_tax = 0 then 0 else cast(l_quantity as int) end as yes_bid,
       case when l_tax = 0 then 0 else cast(95 - l_quantity as int) end as no_bid,
       cast(round(l_discount * 100) as int) as last_price
from (select l.*, o.o_orderdate,
             row_number() over (partition by l_orderkey
               order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount,
                        l_tax, l_returnflag, l_linestatus, l_shipdate) as market_no
      from lineitem l join orders o on l.l_orderkey = o.o_orderkey) z
"""

# Markets with every field of the API's market record. Some quotes are absent
# (NULL) so that refresh-or-keep and price guards see both cases; some events have no open times.
BLOCKS["fx_feed_markets"] = """
select ticker, event_ticker, l_orderkey, market_no, o_orderdate,
       concat('Will line ', cast(market_no as string), ' of order ', cast(l_orderkey as string),
              ' be delivered?') as title,
       concat('Line ', cast(market_no as string)) as subtitle,
       concat('Delivered, ', status) as yes_sub_title,
       'Not delivered' as no_sub_title,
       concat('Resolves Yes if line ', cast(market_no as string), ' ships before close.') as rules_primary,
       case when market_no % 2 = 0 then ''
            else concat('Returned lines of order ', cast(l_orderkey as string), ' count as No.') end
         as rules_secondary,
       case when l_orderkey % 101 = 50 then ''
            else concat(replace(cast(open_time as string), ' ', 'T'), 'Z') end as open_time,
       concat(replace(cast(close_time as string), ' ', 'T'), 'Z') as close_time,
       concat(replace(cast(close_time as string), ' ', 'T'), 'Z') as expiration_time,
       status, result, 'usd_cent' as response_price_units,
       yes_bid,
       case when market_no = 3 then cast(null as int) else yes_bid + 1 end as yes_ask,
       case when l_orderkey % 89 = 0 then cast(null as int) else no_bid end as no_bid,
       no_bid + 1 as no_ask,
       last_price,
       case when l_orderkey % 7 = 0 then cast(null as bigint)
            else cast(market_no * 100 + last_price as bigint) end as volume,
       cast(yes_bid * 10 as bigint) as liquidity
from fx_markets
"""

# Every order as an event of the feed, with the day it was placed. Orders of one
# kind have no category.
BLOCKS["fx_all_events"] = """
select concat('O', cast(o_orderkey as string)) as event_ticker,
       concat('C', cast(o_custkey as string)) as series_ticker,
       concat('Order ', cast(o_orderkey as string)) as title,
       concat('Status ', o_orderstatus) as sub_title,
       o_orderstatus = 'F' as mutually_exclusive,
       case when o_orderpriority = '5-LOW' and o_orderstatus = 'P' then cast(null as string)
            when o_orderkey % 1000 = 5 then 'Rare' when o_orderkey % 500 = 3 then 'Small'
            else o_orderpriority end as category,
       o_orderkey as feed_pos, o_orderdate
from orders
"""

# Today's open-events feed (before the market-count filter): orders placed since
# the oldest that is still open.
BLOCKS["fx_feed_events"] = """
select event_ticker, series_ticker, title, sub_title, mutually_exclusive, category, feed_pos
from fx_all_events where o_orderdate >= timestamp '1996-06-01 00:00:00'
"""

# Yesterday's active-event state: orders placed by then; (added_on, feed_pos) is the list order.
BLOCKS["fx_prev_events"] = """
select event_ticker, series_ticker, title, sub_title, mutually_exclusive, category,
       case when feed_pos % 3 = 0 then '20250830' else '20250831' end as added_on, feed_pos
from fx_all_events where o_orderdate < timestamp '2000-06-01 00:00:00'
"""

# Report index entries already stored on yesterday's events (map in long form).
# Some already hold today's stamp: a rerun of the same day.
BLOCKS["fx_prev_event_reports"] = """
select concat('O', cast(o_orderkey as string)) as event_ticker, '20250831' as stamp,
       concat('ddgs_o', cast(o_orderkey as string), '_20250831') as hash_id
from orders where o_orderdate < timestamp '2000-06-01 00:00:00' and o_orderkey % 4 = 0
union all
select concat('O', cast(o_orderkey as string)) as event_ticker, '20250901' as stamp,
       concat('ddgs_o', cast(o_orderkey as string), '_20250901') as hash_id
from orders where o_orderdate < timestamp '2000-06-01 00:00:00' and o_orderkey % 8 = 1
"""

# Yesterday's active-market state, with yesterday's quotes and price entry: the
# markets that had traded by then. Some are stored twice (copy_no 1, later in the list).
BLOCKS["fx_prev_markets"] = """
select ticker, event_ticker, title, subtitle, yes_sub_title, no_sub_title, rules_primary,
       rules_secondary, open_time, close_time, expiration_time, status, response_price_units,
       yes_bid + 2 as yes_bid, yes_ask, no_bid, no_ask, last_price, volume - 1 as volume, liquidity,
       cast(last_price as double) / 100 as prev_price,
       cast(l_orderkey * 100 + market_no as bigint) as state_pos, 0 as copy_no
from fx_feed_markets
where o_orderdate < timestamp '2000-06-01 00:00:00' and last_price > 0
union all
select ticker, event_ticker, title, subtitle, yes_sub_title, no_sub_title, rules_primary,
       rules_secondary, open_time, close_time, expiration_time, status, response_price_units,
       yes_bid + 5 as yes_bid, yes_ask, no_bid, no_ask, last_price, volume, liquidity,
       cast(last_price as double) / 50 as prev_price,
       cast(1000000000000 + l_orderkey * 100 + market_no as bigint) as state_pos, 1 as copy_no
from fx_feed_markets
where o_orderdate < timestamp '2000-06-01 00:00:00' and market_no = 1 and last_price = 10
"""

# Event detail as the API returns it for a dropped event (header part; the
# markets are fx_feed_markets of the same event). For some events it gives none.
BLOCKS["fx_details"] = """
select concat('O', cast(o_orderkey as string)) as event_ticker,
       concat('Order ', cast(o_orderkey as string)) as title,
       case when o_orderkey % 13 = 0 then cast(null as string) else o_orderpriority end as category,
       o_orderkey % 2 = 0 as markets_key_absent
from orders where o_orderkey % 97 <> 31
"""

# The detail headers of all events, for queries whose job takes every event.
BLOCKS["fx_all_details"] = """
select concat('O', cast(o_orderkey as string)) as event_ticker,
       concat('Order ', cast(o_orderkey as string)) as title,
       case when o_orderkey % 13 = 0 then cast(null as string) else o_orderpriority end as category,
       o_orderkey % 2 = 0 as markets_key_absent
from orders
"""

# Stored report documents: present, present-but-empty, a second document after
# an empty first one, and a document without the report field.
BLOCKS["fx_reports"] = """
select '20250901' as timestamp, concat('O', cast(o_orderkey as string)) as event_ticker,
       case when o_orderkey % 15 = 0 then ''
            else concat('# Research Report 1 for order ', cast(o_orderkey as string)) end as ddgs_report,
       cast(1 as bigint) as doc_seq
from orders where o_orderkey % 3 = 0
union all
select '20250901' as timestamp, concat('O', cast(o_orderkey as string)) as event_ticker,
       concat('# Research Report 1 rebuilt for order ', cast(o_orderkey as string)) as ddgs_report,
       cast(2 as bigint) as doc_seq
from orders where o_orderkey % 30 = 0
union all
select '20250901' as timestamp, concat('O', cast(o_orderkey as string)) as event_ticker,
       cast(null as string) as ddgs_report, cast(1 as bigint) as doc_seq
from orders where o_orderkey % 3 = 1 and o_orderkey % 11 = 0
union all
select '20250831' as timestamp, concat('O', cast(o_orderkey as string)) as event_ticker,
       concat('# Research Report 1 of the day before for order ', cast(o_orderkey as string)) as ddgs_report,
       cast(1 as bigint) as doc_seq
from orders where o_orderkey % 5 = 0
union all
select '20250830' as timestamp, concat('O', cast(o_orderkey as string)) as event_ticker,
       case when o_orderkey % 4 = 0 then cast(null as string) else 'An early report' end as ddgs_report,
       cast(1 as bigint) as doc_seq
from orders where o_orderkey % 6 = 0
"""

# Ranked web-search results per (event, query line). Four results in a row
# point at the same page, so URLs repeat inside a query.
BLOCKS["fx_search_results"] = """
select concat('O', cast(cast(floor(d.doc_id / 30) as bigint) as string)) as event_ticker,
       cast(d.doc_id % 2 + 1 as bigint) as query_no,
       cast(row_number() over (partition by cast(floor(d.doc_id / 30) as bigint), d.doc_id % 2
                               order by d.doc_id) as bigint) as rnk,
       p.url as href,
       concat('Result ', cast(d.doc_id as string)) as title,
       d.text as body,
       date '2025-08-31' - cast(d.n_chars % 730 as int) as published
from documents d join pages p on p.page_id = cast(floor(d.doc_id / 4) as bigint)
"""

# Fetched web pages.
BLOCKS["fx_web_pages"] = """
select url, 200 as http_status, html
from pages
"""

# Prompt turn -> model answer; NULL when the model gave nothing.
BLOCKS["fx_completions"] = """
select u.conv_id, u.turn as section_no, u.text as prompt, a.text as completion
from conversations u left join conversations a
  on a.conv_id = u.conv_id and a.turn = u.turn + 1 and a.role = 'assistant'
where u.role = 'user'
"""

# Frozen model output per prompt key (event, purpose, query line): the first
# answer of a conversation is the query list, later ones are summaries.
BLOCKS["fx_model_outputs"] = """
select concat('O', cast(conv_id as string)) as event_ticker,
       case when k = 1 then 'queries' else 'summary' end as purpose,
       cast(k - 1 as bigint) as query_no,
       completion
from (select conv_id, completion,
             row_number() over (partition by conv_id order by section_no) as k
      from fx_completions) z
"""

# Events with stored reports (a report a day, on days with a purchase by the user)
# and the day after their last activity.
BLOCKS["fx_report_events"] = """
select concat('U', cast(user_id as string)) as event_ticker, max(cast(ts as date)) as resolved_on
from events group by user_id
"""
BLOCKS["fx_report_days"] = """
select distinct concat('U', cast(user_id as string)) as event_ticker, replace(cast(cast(ts as date) as string), '-', '') as stamp,
       concat('ddgs_u', cast(user_id as string), '_', replace(cast(cast(ts as date) as string), '-', '')) as hash_id
from events where event_type = 'purchase'
"""

# Daily presence of a ticker with its closing price; an error leaves a day without one.
BLOCKS["fx_presence"] = """
select ticker, day, price from (
  select user_id as ticker, cast(ts as date) as day,
         case when event_type = 'error' then cast(null as double) else value end as price,
         row_number() over (partition by user_id, cast(ts as date) order by ts desc, event_id desc) as rn
  from events) z where rn = 1
"""

# Dependencies of each block on earlier blocks.
DEPENDS: dict[str, tuple[str, ...]] = {
    "fx_markets": (),
    "fx_feed_markets": ("fx_markets",),
    "fx_all_events": (),
    "fx_feed_events": ("fx_all_events",),
    "fx_prev_events": ("fx_all_events",),
    "fx_prev_event_reports": (),
    "fx_prev_markets": ("fx_feed_markets",),
    "fx_details": (),
    "fx_all_details": (),
    "fx_reports": (),
    "fx_search_results": (),
    "fx_web_pages": (),
    "fx_completions": (),
    "fx_model_outputs": ("fx_completions",),
    "fx_presence": (),
    "fx_report_events": (),
    "fx_report_days": (),
}


def closure(names) -> list[str]:
    """Blocks needed for ``names``, in dependency order."""
    seen: list[str] = []

    def visit(n):
        for d in DEPENDS[n]:
            visit(d)
        if n not in seen:
            seen.append(n)

    for n in names:
        visit(n)
    order = list(BLOCKS)
    return sorted(seen, key=order.index)


def with_clause(names) -> str:
    """``WITH`` prefix defining the blocks (for the DuckDB oracle)."""
    parts = [f"{n} AS ({BLOCKS[n].strip()})" for n in closure(names)]
    return "WITH " + ",\n".join(parts) + "\n"

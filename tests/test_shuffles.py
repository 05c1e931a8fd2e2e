"""What the market queries and their inputs shuffle and write (physical plans without broadcasts)."""

import contextlib

from frostline.operators import reconcile as rc
from frostline.plans import catalog
from frostline.plans.q_reconcile import DAY
from frostline.sources import tables

from conftest import SMALL

catalog.load_all()


@contextlib.contextmanager
def _sorted_joins(spark):
    """Joins as large tables have them."""
    confs = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    old = {k: spark.conf.get(k) for k in confs}
    for k, v in confs.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def _exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [ln for ln in plan.splitlines() if " Exchange " in ln]


def test_nested_markets_need_one_shuffle_of_the_lines(spark):
    with _sorted_joins(spark):
        moved = _exchanges(tables._events_with_markets(spark, SMALL))
    # lines, days of their orders, events: no wide market, no fixed number of files
    assert len(moved) == 3 and not any("RoundRobin" in ln for ln in moved)


def test_feeds_details_and_markets_are_read_from_one_table(spark):
    every = set(tables.events_with_markets(spark, SMALL).inputFiles())
    for made in (tables.current_feed, tables.all_events_feed, tables.event_details, tables.all_event_details, tables.previous_markets):
        assert set(made(spark, SMALL).inputFiles()) == every
        with _sorted_joins(spark):
            assert not _exchanges(made(spark, SMALL))


def test_views_of_the_one_table_have_the_rows_of_their_blocks(spark):
    same = lambda a, b: not a.exceptAll(b).take(1) and not b.exceptAll(a).take(1)
    block = lambda name: tables._standin_plan(spark, SMALL, name)
    stored = tables.previous_markets(spark, SMALL).selectExpr("* except (market_price)", "market_price['20250831'] as prev_price")
    assert same(stored.select(*sorted(stored.columns)), block("fx_prev_markets").select(*sorted(stored.columns)))
    feed = tables.current_feed(spark, SMALL).drop("status", "markets")
    assert same(feed, block("fx_feed_events").select(*feed.columns))
    for made, name in ((tables.event_details, "fx_details"), (tables.all_event_details, "fx_all_details")):
        head = made(spark, SMALL).select("event_ticker", "title", "category")
        assert same(head, block(name).select(*head.columns))
        bare = made(spark, SMALL).where("markets is null or size(markets) = 0").selectExpr("event_ticker", "markets is null")
        markets = block("fx_feed_markets").select("event_ticker")
        assert same(bare, block(name).join(markets, "event_ticker", "left_anti").select("event_ticker", "markets_key_absent"))


def test_refreshed_markets_move_stored_rows_once(spark):
    with _sorted_joins(spark):
        moved = _exchanges(catalog.QUERIES["markets_refreshed"](spark, SMALL))
    assert moved and all("hashpartitioning(ticker#" in ln or "hashpartitioning(_ticker#" in ln for ln in moved)
    assert not any("state_pos#" in ln.split("hashpartitioning")[1].split(")")[0] for ln in moved)


def test_details_travel_as_facts(spark):
    with _sorted_joins(spark):
        events = rc.classified_events(tables.current_feed(spark, SMALL), tables.event_details(spark, SMALL),
                                      tables.previous_events(spark, SMALL), tables.reports(spark, SMALL), DAY)
        moved = _exchanges(events)
    # only the report entries are met by the ticker of the outer join
    assert sum("hashpartitioning(_event#" in ln for ln in moved) == 1
    plan = events._jdf.queryExecution().executedPlan().toString()
    # market arrays are reduced to facts below every shuffle
    assert plan.rindex("array_min") > plan.index("Exchange")


def test_active_events_move_every_row_once(spark):
    with _sorted_joins(spark):
        moved = _exchanges(catalog.QUERIES["active_events"](spark, SMALL))
    # stored and feed rows together, and the report documents
    assert len(moved) == 2 and all("hashpartitioning(event_ticker#" in ln for ln in moved)


def test_stored_events_and_their_entries_are_one_scan(spark):
    stored = tables.previous_events(spark, SMALL)
    with _sorted_joins(spark):
        assert not _exchanges(stored)
    same = lambda a, b: a.count() == b.count() and not a.exceptAll(b).take(1)
    block = lambda name: tables._standin_plan(spark, SMALL, name)
    plain = stored.drop("bing_reports", "ddgs_reports")
    assert same(plain, block("fx_prev_events").selectExpr(*plain.columns))
    entries = stored.selectExpr("event_ticker", "explode(ddgs_reports) as (stamp, hash_id)")
    assert entries.select("stamp").distinct().count() == 2 and same(entries, block("fx_prev_event_reports"))


def test_orders_travel_to_their_markets_as_they_are(spark):
    with _sorted_joins(spark):
        plan = tables._events_with_markets(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    # an event's texts are made above every shuffle
    assert 0 < plan.rindex("concat(Order ") < plan.index("Exchange")

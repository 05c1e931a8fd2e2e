"""Queries that take every event: no detail record is left out."""

import pytest

from frostline.plans import catalog
from frostline.sources import tables

from conftest import SMALL

catalog.load_all()
MEDIUM = "/root/testdata/sf0.01"


def _cut(keys):
    return {f"O{k}" for k in keys if k % 97 == 31}


def _tickers(spark, name):
    return {r[0] for r in catalog.QUERIES[name](spark, SMALL).select("event_ticker").distinct().collect()}


def _described(spark):
    return {f"O{r[0]}" for r in tables.table(spark, SMALL, "lineitem").select("l_orderkey").distinct().collect()}


WHOLE = ["market_descriptions", "query_prompts"]
ANSWERED = ["query_lines", "context_report", "query_contract"]


@pytest.mark.parametrize("name", WHOLE)
def test_every_described_event(spark, name):
    want = _described(spark)
    assert want & _cut(range(10_000)) and _tickers(spark, name) == want
    assert "% 97" not in catalog.ORACLE[name]


@pytest.mark.parametrize("name", ANSWERED)
def test_every_event_with_an_answer(spark, name):
    got = {r[0] for r in catalog.QUERIES[name](spark, MEDIUM).select("event_ticker").distinct().collect()}
    assert "% 97" not in catalog.ORACLE[name]
    assert "O31" in got  # asked in conversation 31, which the smallest tables lack


def test_every_resolved_market_is_scored(spark):
    assert "% 97" not in catalog.ORACLE["strategy_score"]
    from frostline.operators import reconcile as rc
    from frostline.plans.q_reconcile import day_state
    gone = rc.first_stored(day_state(spark, SMALL)["resolved_markets_new"].select("ticker", "event_ticker", "market_price", "state_pos"))
    decided = (tables.standin(spark, SMALL, "fx_feed_markets").where("result in ('yes', 'no')").select("ticker")
               .join(gone, "ticker", "left_semi").count())
    got = {r.strategy: r.k for r in catalog.QUERIES["strategy_score"](spark, SMALL).groupBy("strategy").agg({"n": "sum"})
           .withColumnRenamed("sum(n)", "k").collect()}
    assert decided > 0 and got == {"last_price": decided, "coin": decided}

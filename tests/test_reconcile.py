"""Contract tests of the daily reconcile (inline frames, hand-computed answers)."""

from pyspark.sql import functions as F

from frostline import schemas
from frostline.functions import prices
from frostline.operators import reconcile as rc

MFIELDS = [f.split()[0] for f in schemas.API_MARKET_FIELDS.split(", ")]
EFIELDS = [f.split()[0] for f in schemas.ACTIVE_EVENTS.split(", ")]


def market(**kw):
    base = dict(status="active", open_time="2025-08-01T00:00:00Z", close_time="2025-09-30T00:00:00Z",
                expiration_time="2025-09-30T00:00:00Z", title="t", yes_sub_title="y", rules_primary="r",
                yes_bid=10, no_bid=30, last_price=50)
    base.update(kw)
    return tuple(base.get(f) for f in MFIELDS)


def feed(spark, events):
    rows = [(e["event_ticker"], "S", "T " + e["event_ticker"], "sub", False, e.get("category", "C"), "open",
             e.get("feed_pos", i), e.get("markets")) for i, e in enumerate(events)]
    return spark.createDataFrame(rows, schemas.API_EVENT)


def state_events(spark, rows):
    full = [(r[0], "S", r[1], "sub", False, "C", {}, r[2] if len(r) > 2 else {}, "20250831", i)
            for i, r in enumerate(rows)]
    return spark.createDataFrame(full, schemas.ACTIVE_EVENTS)


def details(spark, rows):
    return spark.createDataFrame(rows, schemas.EVENT_DETAIL)


def test_market_limit_and_missing_markets(spark):
    f = feed(spark, [dict(event_ticker="A", markets=[]),
                     dict(event_ticker="B", markets=[market(ticker=f"B{i}") for i in range(6)]),
                     dict(event_ticker="C", markets=[market(ticker="C1")] * 5),
                     dict(event_ticker="D", markets=None)])
    valid, bad = rc.split_feed(f)
    assert sorted(r[0] for r in valid.select("event_ticker").collect()) == ["A", "C"]
    assert [tuple(r) for r in bad.collect()] == [("D", "feed_markets_missing")]


def test_classification_and_retained_row_kept(spark):
    prev = state_events(spark, [("A", "old title A"), ("B", "old title B")])
    cur = feed(spark, [dict(event_ticker="A", markets=[]), dict(event_ticker="C", markets=[])])
    got = {r[0]: r[1] for r in rc.classify_events(prev, cur).collect()}
    assert got == {"A": "retained", "B": "dropped", "C": "new"}
    kept = rc.retained_events(prev, cur).collect()
    assert [(r.event_ticker, r.title) for r in kept] == [("A", "old title A")]
    new = rc.new_events(prev, cur, "20250901").collect()
    assert [(r.event_ticker, r.added_on, r.ddgs_reports) for r in new] == [("C", "20250901", {})]


def test_resolution_two_time_formats_and_quarantine(spark):
    prev = state_events(spark, [("A", "a"), ("B", "b"), ("C", "c"), ("D", "d")])
    cur = feed(spark, [])
    det = details(spark, [
        ("A", "Ev A", None, [market(ticker="A1", status="finalized", result="yes",
                            open_time="2025-08-26T19:30:40.273125Z", close_time="2025-09-02T10:00:00Z"),
                     market(ticker="A2", status="closed", result="",
                            open_time="2025-08-20T00:00:00Z", close_time="2025-09-05T23:59:59.5Z")]),
        ("B", "Ev B", "Politics", [market(ticker="B1", status="active")]),
        ("C", "Ev C", "X", []),
    ])
    res, quar = rc.resolve_dropped(rc.dropped_events(prev, cur), det)
    got = {r.event_ticker: r for r in res.collect()}
    a = got["A"]
    assert (a.resolution_date, a.latest_close_time, a.earliest_open_time) == ("2025-09-05", "2025-09-05", "2025-08-20")
    assert a.category == "Uncategorized" and a.is_resolved and a.has_resolved
    assert got["B"].category == "Politics" and not got["B"].is_resolved and not got["B"].has_resolved
    assert sorted(tuple(r) for r in quar.collect()) == [("C", "no_markets"), ("D", "detail_missing")]


def test_implied_price_rules(spark):
    df = spark.createDataFrame([(10, 30, 50), (0, 5, 50), (0, 0, 42), (None, 5, 50), (0, 0, None)],
                               "yes_bid int, no_bid int, last_price int")
    got = [r[0] for r in df.select(prices.implied_price()).collect()]
    assert got == [0.25, 0.0, 0.42, None, None]


def test_price_map_upsert(spark):
    df = spark.createDataFrame([({"20250831": 0.1, "20250901": 0.2},), (None,)], "m map<string,double>")
    got = [r[0] for r in df.select(prices.upsert_price(F.col("m"), "20250901", F.lit(0.5))).collect()]
    assert got == [{"20250831": 0.1, "20250901": 0.5}, {"20250901": 0.5}]


def _prev_markets(spark, rows):
    out = []
    for ticker, pos, yes_bid, status in rows:
        m = dict(zip(MFIELDS, market(ticker=ticker, event_ticker="E", status=status, yes_bid=yes_bid,
                                     yes_ask=99, volume=7)))
        out.append(tuple(m[f] for f in schemas.MARKET_STATE_FIELDS) + ({"20250831": 0.3}, pos))
    return spark.createDataFrame(out, schemas.ACTIVE_MARKETS)


def test_known_market_refresh_first_copy_and_resolved_copies(spark):
    prev = _prev_markets(spark, [("M1", 5, 1, "initialized"), ("M1", 2, 2, "initialized"),
                                 ("M2", 3, 3, "active"), ("M2", 9, 4, "active")])
    cur = feed(spark, [dict(event_ticker="E", markets=[
        market(ticker="M1", event_ticker="E", status="active", yes_bid=10, no_bid=30, yes_ask=None, volume=None),
        market(ticker="M3", event_ticker="E", status="active", yes_bid=1, no_bid=1)])])
    valid, _ = rc.split_feed(cur)
    active = rc.active_markets_today(valid)
    ref = rc.refreshed_markets(active, prev, "20250901").collect()
    assert len(ref) == 1
    r = ref[0]
    # quotes from today, absent ones from the first stored copy (state_pos 2); status stays first-seen
    assert (r.ticker, r.yes_bid, r.yes_ask, r.volume, r.status) == ("M1", 10, 99, 7, "initialized")
    assert r.market_price == {"20250831": 0.3, "20250901": 0.25}
    new = rc.new_markets(active, prev, "20250901").collect()
    assert [(n.ticker, n.market_price, n.rules_secondary) for n in new] == [("M3", {"20250901": 0.5}, "")]
    final = rc.new_markets(active, prev, "20250901").unionByName(rc.refreshed_markets(active, prev, "20250901"))
    gone = rc.resolved_markets(prev, final, "20250901").collect()
    assert sorted((g.ticker, g.state_pos, g.resolution_date) for g in gone) == [
        ("M2", 3, "20250901"), ("M2", 9, "20250901")]


def test_report_index_rules(spark):
    ev = state_events(spark, [("A", "a", {"20250901": "kept"}), ("B", "b"), ("C", "c"), ("D", "d")])
    reports = spark.createDataFrame([
        ("20250901", "A", "x", 1), ("20250901", "B", "", 1), ("20250901", "C", None, 1),
        ("20250901", "C", "late", 2), ("20250831", "D", "old", 1)], schemas.REPORTS)
    first = rc.first_reports(reports, ["20250901"])
    out = {r.event_ticker: r.ddgs_reports for r in rc.add_report_ids(ev, rc.report_entries(first)).collect()}
    # A: day present, not overwritten. B: empty report still indexed. C: first document has no
    # report field. D: only another day.
    assert out == {"A": {"20250901": "kept"}, "B": {"20250901": "ddgs_b_20250901"}, "C": {}, "D": {}}


def test_reconcile_invariants_on_fixture(spark):
    from frostline.plans.q_reconcile import _inputs
    from conftest import SMALL
    inp = _inputs(spark, SMALL)
    out = rc.reconcile(stamp="20250901", **inp)
    prev = inp["prev_events"]
    valid, _ = rc.split_feed(inp["feed"])
    kept = rc.retained_events(prev, valid).count()
    dropped = rc.dropped_events(prev, valid).count()
    assert kept + dropped == prev.count()
    assert out["active_events"].count() == valid.count()
    resolved = out["resolved_events_new"].count()
    quarantined = out["quarantine"].count()
    assert resolved + quarantined == dropped
    act = out["active_markets"].select("ticker")
    assert act.join(out["resolved_markets_new"], "ticker").count() == 0
    assert out["active_markets"].select("ticker").distinct().count() == out["active_markets"].count()


def test_event_growing_to_market_limit_is_dropped_and_resolved(spark):
    prev = state_events(spark, [("G", "grows")])
    six = [market(ticker=f"G{i}", event_ticker="G", status="active") for i in range(6)]
    cur = feed(spark, [dict(event_ticker="G", markets=six)])
    valid, _ = rc.split_feed(cur)
    assert valid.count() == 0
    det = details(spark, [("G", "grows", "Econ", six)])
    pm = _prev_markets(spark, [("G0", 1, 1, "active")])
    out = rc.reconcile(cur, det, prev, pm, spark.createDataFrame([], schemas.REPORTS), "20250901")
    res = out["resolved_events_new"].collect()
    assert [(r.event_ticker, r.is_resolved, r.has_resolved, r.category) for r in res] == [("G", False, False, "Econ")]
    gone = out["resolved_markets_new"].collect()
    assert [(g.ticker, g.resolution_date) for g in gone] == [("G0", "20250901")]
    assert out["active_events"].count() == 0 and out["active_markets"].count() == 0


def test_active_state_is_the_retained_and_the_new_rows(spark):
    """Repeated and missing tickers on both sides: a stored row stays once however often it is fed."""
    prev = state_events(spark, [("A", "a"), ("A", "a2"), ("B", "b"), ("C", "c"), (None, "x")])
    cur = feed(spark, [dict(event_ticker=t, markets=[]) for t in ("A", "A", "A", "C", "D", "D")])
    cur = cur.unionByName(cur.where("event_ticker = 'D'").limit(1).withColumn("event_ticker", F.lit(None).cast("string")))
    got = rc.active_events(prev, cur, "20250901")
    cols = [c for c in EFIELDS if not c.endswith("_reports")]
    rows = lambda df: sorted(map(repr, df.select(*cols).collect()))
    assert rows(got.where("not is_new")) == rows(rc.retained_events(prev, cur)) and got.where("not is_new").count() == 3
    assert rows(got.where("is_new")) == rows(rc.new_events(prev, cur, "20250901")) and got.where("is_new").count() == 3


def test_new_events_take_todays_entry_and_stored_ones_the_lookback(spark):
    prev = state_events(spark, [("A", "a"), ("B", "b", {"20250831": "kept"})])
    cur = feed(spark, [dict(event_ticker=t, markets=[]) for t in ("A", "B", "N")])
    reports = spark.createDataFrame(
        [(d, t, "r", 2) for d in ("20250830", "20250831", "20250901") for t in ("A", "B", "N")]
        + [("20250830", "A", None, 1), ("20250829", "A", "r", 1)], schemas.REPORTS)
    empty = [spark.createDataFrame([], s) for s in (schemas.EVENT_DETAIL, schemas.ACTIVE_MARKETS)]
    out = rc.reconcile(cur, empty[0], prev, empty[1], reports, "20250901", ["20250830", "20250831"])
    got = {r.event_ticker: r.ddgs_reports for r in out["active_events"].collect()}
    # A's first document of the 30th has no report
    assert got == {"A": {"20250831": "ddgs_a_20250831"},
                   "B": {"20250830": "ddgs_b_20250830", "20250831": "kept"}, "N": {"20250901": "ddgs_n_20250901"}}


def test_that_a_document_has_a_report_travels_not_its_text(spark):
    reports = spark.createDataFrame([("20250901", "A", "x", 1), ("20250901", "B", "", 1)], schemas.REPORTS)
    plan = rc.stored_entries(reports, ["20250901"])._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by(CASE WHEN isnotnull(ddgs_report" in plan and "partial_min_by(ddgs_report" not in plan

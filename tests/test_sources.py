"""JSON sources (feed dump, state file) and the report look-back window."""

import json

from pyspark.sql import functions as F

from frostline import schemas
from frostline.functions import dates
from frostline.operators import reconcile as rc
from frostline.sources import state as stt

from test_reconcile import state_events


def test_feed_and_state_json(spark, scratch):
    feed = [{"event_ticker": "E1", "series_ticker": "S", "title": "T", "sub_title": "s",
             "mutually_exclusive": True, "category": "Politics", "status": "open", "feed_pos": 0,
             "markets": [{"ticker": "E1-A", "event_ticker": "E1", "status": "active", "yes_bid": 3,
                          "no_bid": 7, "last_price": 40, "open_time": "2025-08-26T19:30:40.273125Z",
                          "volume": 12}]},
            {"event_ticker": "E2", "series_ticker": "S", "title": "T2", "status": "open", "feed_pos": 1,
             "markets": []}]
    path = f"{scratch}/feed.json"
    with open(path, "w") as f:
        json.dump(feed, f, indent=4)
    whole = stt.read_feed_json(spark, path, lines=False)
    with open(f"{scratch}/feed.jsonl", "w") as f:
        f.writelines(json.dumps(r) + "\n" for r in feed)
    df = stt.read_feed_json(spark, f"{scratch}/feed.jsonl")
    assert sorted(map(str, df.collect())) == sorted(map(str, whole.collect()))
    assert df.schema.simpleString() == spark.createDataFrame([], schemas.API_EVENT).schema.simpleString()
    rows = {r.event_ticker: r for r in df.collect()}
    m = rows["E1"].markets[0]
    assert (m.ticker, m.yes_bid, m.volume, m.result) == ("E1-A", 3, 12, None)
    assert rows["E2"].markets == [] and rows["E2"].category is None
    valid, _ = rc.split_feed(df)
    price = rc.active_markets_today(valid).select("price").first()[0]
    assert price == 0.3

    state = [{"event_ticker": "E1", "title": "T", "category": "C", "bing_reports": {},
              "ddgs_reports": {"20250831": "ddgs_e1_20250831"}, "added_on": "20250831", "feed_pos": 4}]
    spath = f"{scratch}/active_events.json"
    with open(spath, "w") as f:
        json.dump(state, f, indent=4)
    st = stt.read_json_state(spark, spath, stt.ACTIVE_EVENTS).first()
    assert st.ddgs_reports == {"20250831": "ddgs_e1_20250831"} and st.feed_pos == 4


def test_lookback_window(spark):
    assert dates.lookback_stamps("2025-09-01", 3) == ["20250901", "20250831", "20250830"]
    prev = state_events(spark, [("A", "a", {"20250830": "x"}), ("B", "b")])
    reports = spark.createDataFrame([
        ("20250901", "A", "r", 1), ("20250831", "A", "r", 1), ("20250830", "A", "r", 1),
        ("20250831", "B", "r", 1), ("20250831", "C", "r", 1), ("20250901", "C", "r", 1)], schemas.REPORTS)
    from test_reconcile import feed
    cur = feed(spark, [dict(event_ticker="A", markets=[]), dict(event_ticker="C", markets=[])])
    det = spark.createDataFrame([("B", "b", "X", [])], schemas.EVENT_DETAIL)
    prev_m = spark.createDataFrame([], schemas.ACTIVE_MARKETS)
    out = rc.reconcile(cur, det, prev, prev_m, reports, "20250901",
                       lookback=dates.lookback_stamps("2025-09-01", 3))
    got = {r.event_ticker: r.ddgs_reports for r in out["active_events"].collect()}
    # retained: every look-back day not yet indexed; new: today only
    assert got == {"A": {"20250830": "x", "20250831": "ddgs_a_20250831", "20250901": "ddgs_a_20250901"},
                   "C": {"20250901": "ddgs_c_20250901"}}
    assert [tuple(r) for r in out["quarantine"].collect()] == [("B", "no_markets")]


def test_lookback_column_matches_parameter(spark):
    import datetime as dt
    df = spark.createDataFrame([(dt.date(2025, 3, 1),), (dt.date(2024, 1, 1),)], "d date")
    got = [r[0] for r in df.select(dates.lookback_stamps_col("d", 3)).collect()]
    assert got == [dates.lookback_stamps("2025-03-01", 3), dates.lookback_stamps("2024-01-01", 3)]
    assert df.select(dates.lookback_stamps_col("d")).first()[0] == ["20250301"]


def test_one_large_array_file_is_read_by_many_tasks(spark, scratch):
    """Records with nested maps, arrays at their end, and strings that look like a border: the rows of a whole-file read."""
    ddl = "a string, m map<string,string>, n array<struct<x:int,y:string>>, z array<int>"
    records = [{"a": f"line\n    }},\n    {{ {i}", "m": {"k": "},", "]": "\n]"} if i % 3 else {}, "n": [{"x": i, "y": "[{"}] * (i % 4), "z": list(range(i % 5))}
               for i in range(4000)]
    path = f"{scratch}/array.json"
    with open(path, "w") as f:
        json.dump(records, f, indent=4)
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        got = stt.read_json_array(spark, path, ddl)
        assert got.rdd.getNumPartitions() > 4
        rows = lambda df: sorted(map(repr, df.select("a", F.array_sort(F.map_entries("m")), "n", "z").collect()))
        assert rows(got) == rows(spark.read.option("multiLine", True).schema(ddl).json(path))
        assert got.select("a").count() == 4000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    for k, (text, n) in enumerate([("[]", 0), ("[\n]", 0), (json.dumps(records[:7]), 7), (json.dumps(records[:1], indent=4) + "\n", 1), (json.dumps(records[3:5], indent=4), 2)]):
        with open(f"{scratch}/{k}.json", "w") as f:
            f.write(text)
        assert stt.read_json_array(spark, f"{scratch}/{k}.json", ddl).count() == n, text[:20]

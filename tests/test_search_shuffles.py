"""What the queries over search results and few events shuffle (physical plans without adaptive changes)."""

import contextlib

from frostline.operators import reconcile as rc
from frostline.plans import catalog
from frostline.plans.q_reconcile import DAY
from frostline.sources import standins, tables

from conftest import SMALL

catalog.load_all()
MEDIUM = "/root/testdata/sf0.01"


@contextlib.contextmanager
def _planned(spark, threshold):
    """Plans as made beforehand, with broadcasts of up to ``threshold`` bytes."""
    confs = {"spark.sql.autoBroadcastJoinThreshold": str(threshold), "spark.sql.adaptive.enabled": "false"}
    old = {k: spark.conf.get(k) for k in confs}
    for k, v in confs.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _shuffled_scans(plan):
    """The scans whose rows are shuffled before they meet any others."""
    lines, out = plan.splitlines(), []
    for i, ln in enumerate(lines):
        if " Exchange hashpartitioning" in ln:
            end = next((x for x in lines[i + 1:] if "Join" in x or "Exchange" in x or "FileScan" in x), "")
            out += [end] if "FileScan" in end else []
    return out


def test_search_keys_and_bodies_are_the_rows_of_the_block(spark):
    keys, block = tables.search_keys(spark, SMALL), tables._standin_plan(spark, SMALL, "fx_search_results")
    whole = keys.join(tables.search_bodies(spark, SMALL), "body_id").select(*block.columns)
    assert "body" not in keys.columns and keys.count() == block.count()
    assert not whole.exceptAll(block).take(1) and not block.exceptAll(whole).take(1)


def test_bodies_move_for_ranked_results_only(spark):
    with _planned(spark, 64 * 1024):
        plan = _plan(catalog.QUERIES["summary_prompts"](spark, MEDIUM))
    # documents are met where they are read, by the few results that are left
    assert "documents.parquet" in plan and "fx_search_results" not in plan
    assert not any("text#" in ln for ln in _shuffled_scans(plan))


def test_asked_events_are_a_small_table(spark):
    """Its size is known, so that the details needn't be shuffled to meet a few tickers."""
    for name in ("query_lines", "context_report", "query_contract"):
        files = catalog.QUERIES[name](spark, SMALL).inputFiles()
        assert any("/asked-events-" in f for f in files), name


def test_descriptions_are_written_once(spark):
    for name in ("summary_prompts", "pair_similarity", "top_articles"):
        files = catalog.QUERIES[name](spark, SMALL).inputFiles()
        assert any("/descriptions-" in f for f in files), name


def test_scored_markets_move_once(spark):
    with _planned(spark, -1):
        plan = _plan(catalog.QUERIES["strategy_score"](spark, SMALL))
    # stored markets, active tickers, results, what they give, categories, groups
    assert plan.count(" Exchange ") == 6


def test_first_stored_values_are_those_of_the_first_record(spark):
    rows = spark.createDataFrame([("a", 3, "x", 0.3), ("a", 1, "y", None), ("b", 2, "z", 0.2), ("a", 2, "x", 0.1)],
                                 "ticker string, state_pos bigint, event_ticker string, p double")
    got = rc.first_stored(rows, ("event_ticker", "p"))
    assert sorted(map(tuple, got.collect())) == [("a", "y", None), ("b", "z", 0.2)]
    assert not got.exceptAll(rc.first_stored(rows).select(*got.columns)).take(1)


def test_search_results_move_their_bodies_once(spark, tmp_path):
    tables.table(spark, SMALL, "pages").write.parquet(f"{tmp_path}/pages.parquet")
    docs = tables.table(spark, SMALL, "documents")
    # some ids twice, with other texts and with the same
    twice = docs.where("doc_id < 20").selectExpr("* except (text)", "if(doc_id % 2 = 0, 'other', text) as text").select(*docs.columns)
    docs.union(twice).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    at = str(tmp_path)
    for name in ("documents", "pages"):
        tables.table(spark, at, name).createOrReplaceTempView(name)
    block = spark.sql(standins.BLOCKS["fx_search_results"]).drop("rnk")  # equal ids have no order
    made = tables._search_results(spark, at)
    assert made.count() == block.count() == docs.count() + 20
    assert not made.select(*block.columns).exceptAll(block).take(1)
    with _planned(spark, -1):
        plan = _plan(tables._search_results(spark, at))
    # one shuffle of the texts: they meet the keys as they are read
    assert sum("FileScan" in ln and "text#" in ln for ln in plan.splitlines()) == 1
    assert [("text#" in ln) for ln in _shuffled_scans(plan)].count(True) == 1
    assert plan.count(" Window ") == 1 and plan.index("text#") > plan.index(" Window ")


def test_report_job_moves_no_market_texts_of_events_without_results(spark, monkeypatch):
    """The report job describes, for scoring, the events that have results; pending tickers are a small table."""
    from frostline.operators import sampling as sm
    from frostline.plans import report_job
    from frostline.plans.q_reconcile import day_state
    written, settled = {}, report_job.settled

    def seen(df, name):
        written[name] = settled(df, name)
        return written[name]

    monkeypatch.setattr(report_job, "settled", seen)
    sample = sm.stratified_sample(day_state(spark, SMALL)["active_events"], target=2 ** 31)
    results = tables.standin(spark, SMALL, "fx_search_results")
    made = report_job.build_reports(sample, tables.event_details(spark, SMALL), results, tables.standin(spark, SMALL, "fx_web_pages"),
                                    tables.standin(spark, SMALL, "fx_model_outputs"), tables.reports(spark, SMALL), DAY)
    found = {r[0] for r in results.select("event_ticker").distinct().collect()}
    todo = {r[0] for r in written["pending-events"].collect()}
    assert {r[0] for r in written["descriptions"].select("event_ticker").collect()} == found & todo
    assert len(todo) > len(found & todo) > 0 and made["reports"].count() == len(todo)
    with _planned(spark, 64 * 1024):
        plan = _plan(made["reports"])
    assert "/pending-events-" in plan and "title#" not in "".join(_shuffled_scans(plan))

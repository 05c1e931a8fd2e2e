"""Plan properties the scale design relies on (checked on the physical plan text)."""

from frostline.plans import catalog

from conftest import SMALL

catalog.load_all()


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_sample_pick_limits_before_the_shuffle(spark):
    plan = _plan(catalog.QUERIES["stratified_sample"](spark, SMALL))
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_classification_reads_one_market_field(spark):
    plan = catalog.QUERIES["event_lifecycle"](spark, SMALL)._jdf.queryExecution().toString()
    assert "markets:array<struct<ticker:string>>" in plan


def test_no_token_is_shuffled_or_joined_for_the_similarity(spark):
    plan = _plan(catalog.QUERIES["pair_similarity"](spark, SMALL))
    keys = [ln.split("Arguments")[-1] for ln in plan.splitlines() if "Join" in ln or "Exchange hashpartitioning" in ln]
    assert keys and not any("token" in k for k in keys)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_no_article_text_moves_before_the_ranking(spark):
    for name in ("pair_similarity", "top_articles"):
        plan = _plan(catalog.QUERIES[name](spark, SMALL))
        moved = [ln for ln in plan.splitlines() if "Exchange" in ln and "article" in ln and "article_no" not in ln]
        assert not moved and "Scan ExistingRDD" not in plan


def test_resolved_markets_read_the_active_tickers_only(spark):
    plan = _plan(catalog.QUERIES["markets_resolved"](spark, SMALL))
    assert plan.count("FileScan") == 2 and "markets:array<struct<ticker:string,status:string>>" in plan


def test_large_target_is_ranked_in_two_steps(spark):
    from frostline.operators import sampling as sm
    from frostline.plans.q_reconcile import day_state
    keys = sm.sample_keys(day_state(spark, SMALL)["active_events"])
    plan = _plan(sm.draw(keys, target=keys.count() - 1))
    assert "category" in plan and "_b" in plan


def test_sample_reads_the_active_events_once(spark):
    """All that follows the keys table reads nothing else."""
    for name in ("stratified_sample", "sample_batch", "sample_report", "short_list_sample", "sample_quotas"):
        plan = _plan(catalog.QUERIES[name](spark, SMALL))
        scans = [ln for ln in plan.splitlines() if "FileScan" in ln]
        assert scans and all("sample-keys" in ln or "strata" in ln for ln in scans), name


def test_no_query_pairs_everything_with_everything(spark):
    bad = []
    for name, fn in catalog.QUERIES.items():
        plan = _plan(fn(spark, SMALL))
        if "CartesianProduct" in plan or "BroadcastNestedLoopJoin" in plan:
            bad.append(name)
    assert bad == []

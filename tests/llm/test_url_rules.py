import random
from itertools import combinations

import pytest

from frostline.llm import url_rules as U


def pages(n, seed=1):
    r = random.Random(seed)
    return [(i, f"https://{r.choice(['a', 'b', 'Spam'])}.{r.choice(['example', 'site'])}.{r.choice(['org', 'com', 'net'])}/"
                f"{r.choice(['de', 'fr', 'en', 'es'])}/{r.randrange(3)}?{r.choice(['x=1', 'y=2&z', ''])}") for i in range(n)]


def split(url):
    if url is None or "://" not in url:
        return "", "", frozenset()
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, after = rest[:cut].lower(), rest[cut:]
    end = min([after.find(c) for c in "?#" if c in after] or [len(after)])
    query = after[end:].split("#")[0][1:] if after[end:].startswith("?") else ""
    tokens = {f"host:{x}" for x in host.split(".") if x} | {f"path:{x}" for x in after[:end].split("/") if x}
    return host, after[:end], frozenset(tokens | {f"key:{x.split('=')[0]}" for x in query.split("&") if x.split("=")[0]})


def brute(rows, support, confidence, least):
    facts = []
    for i, url in rows:
        host, path, tokens = split(url)
        fits = [r for r in U.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        facts.append((i, host, path, tokens, max(fits, key=lambda r: len(r.text)) if fits else None))
    labelled = [(f[3], f[4].verdict) for f in facts if f[4]]
    need = max(support * len(labelled), min(len(labelled), least))
    found = []
    for k in range(1, 8):
        for combo in combinations(sorted(set().union(*(t for t, _ in labelled))) if labelled else [], k):
            if not any(set(f) <= set(combo) for f in found):
                hits = [v for t, v in labelled if set(combo) <= t]
                bad = hits.count("block")
                if hits and bad >= need and bad / len(hits) >= confidence:
                    found.append(combo)
    return sorted(((i, h, p, r.text if r else None, r.verdict if r else "block" if any(set(f) <= t for f in found) else "allow")
                   for i, h, p, t, r in facts), key=repr)


@pytest.mark.parametrize("support,confidence,least", [(0.02, 0.9, 1), (0.05, 0.6, 5)])
def test_against_brute_force(spark, support, confidence, least):
    rows = pages(150) + [(900, None), (901, "no host"), (902, "x://"), (903, "http://ORG/x"), (904, "http://org"), (905, "http://a.org?q=/de/"), (None, "http://b.net/es/1"),
                         (906, "http://a.com/de/"), (906, "http://a.com/de/"), (907, "http://w.example.org/en/12"), (908, "http://z.net/" + "de/" * 3000), (909, "a://b://c.org/")]
    docs = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "1 as host", "2 as rule", "3 as tokens")
    got = U.judge(docs, U.RULES, support, confidence, least).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows, support, confidence, least)


def test_nothing_to_learn_from(spark):
    schema = "page_id long, url string"
    assert U.judge(spark.createDataFrame([], schema)).count() == 0
    got = U.judge(spark.createDataFrame([(1, "http://a.net/es/1")], schema)).collect()
    assert [tuple(r) for r in got] == [(1, "a.net", "/es/1", None, "allow")]


def test_many_frequent_tokens_end(spark):
    rows = [(i, "http://a.com/de/" + "/".join(f"p{k}" for k in range(40))) for i in range(30)] + [(99, "http://b.net/de/p1")]
    got = {r.page_id: r.verdict for r in U.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    # each token of the labelled urls alone says block
    assert got[0] == "block" and got[99] == "block"


def test_every_frequent_token_is_mined(spark):
    """One token of 43 in each labelled url decides about another."""
    rows = [(i, "http://a.com/de/" + "/".join(f"p{k}" for k in range(40))) for i in range(30)] + [(99, "http://b.net/x/p30"), (98, "http://b.net/x/p40")]
    got = {r.page_id: r.verdict for r in U.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert (got[99], got[98]) == ("block", "allow")


@pytest.mark.parametrize("seed", [1, 2])
def test_long_urls_against_brute_force(spark, seed):
    """Urls of up to 15 frequent tokens; k0 to k2 are always together, and block with q11."""
    r = random.Random(seed)
    rows = []
    for i in range(80):
        held = r.sample([f"q{k}" for k in range(12)], 8) + ["k0", "k1", "k2"] * (i % 2)
        kind = "de" if {"q11", "k0"} <= set(held) else "fr"
        rows.append((i, f"http://a.com/{kind}/" + "/".join(held) + r.choice(["", "?x=1"])))
    rows += [(100 + i, "http://b.net/" + "/".join(r.sample([f"q{k}" for k in range(12)] + ["k0", "k1", "k2", "z"], 6))) for i in range(30)]
    rows += [(200, "http://b.net/k2/q11"), (201, "http://b.net/k1/q3"), (202, "http://b.net/q11")]
    got = U.judge(spark.createDataFrame(rows, "page_id long, url string"), U.RULES, 0.1, 0.8, 5).collect()
    want = brute(rows, 0.1, 0.8, 5)
    assert sorted((tuple(g) for g in got), key=repr) == want
    verdicts = {w[0]: w[4] for w in want}
    assert (verdicts[200], verdicts[201], verdicts[202]) == ("block", "allow", "allow")

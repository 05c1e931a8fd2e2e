import random

import pytest

from frostline.llm import minhash as M


def brute(rows, k, percent):
    def shingles(t):
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
        n = min(k, len(w))
        return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if w else set()

    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    for _ in rows:
        changed = False
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if a and b and rows[i][0] is not None and rows[j][0] is not None and label[i] != label[j] and 100 * len(a & b) >= percent * len(a | b):
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
        if not changed:
            break
    low = {}
    for (i, _), x in zip(rows, label):
        low[x] = min((v for v in (low.get(x), i) if v is not None), default=None)
    return sorted(((i, len(s), low[x], low[x] == i) for (i, _), s, x in zip(rows, sets, label)), key=repr)


def family(seed, size, words, edits, first):
    """Copies of a text with single words changed: some link, some don't."""
    r = random.Random(seed)
    text = [f"w{r.randrange(10 ** 6)}" for _ in range(words)]
    out = []
    for i in range(size):
        own = list(text)
        for _ in range(r.randrange(edits + 1)):
            own[r.randrange(words)] = f"e{r.randrange(10 ** 6)}"
        out.append((first + i, " ".join(own)))
    return out


@pytest.mark.parametrize("k,percent,block", [(3, 85, 2048), (5, 80, 4)])
def test_against_brute_force(spark, monkeypatch, k, percent, block):
    monkeypatch.setattr(M, "BLOCK", block)
    if block == 4:  # too many ids for the filter
        monkeypatch.setattr(M, "FILTER_IDS", 3)
    rows = family(1, 30, 120, 6, 100) + family(2, 25, 200, 12, 200) + family(3, 12, 40, 1, 50)
    rows += [(1, None), (2, ""), (3, " \n"), (4, "Two words"), (5, "two  WORDS\n"), (6, "one"), (7, "one"), (None, "one"), (8, "x " * 30000), (9, "X " * 29000), (7, "one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as node", "2 as component_id", "3 as key")
    got = sorted((tuple(r) for r in M.near_duplicates(docs, k, percent).select("doc_id", "n_shingles", "component_id", "kept").collect()), key=repr)
    assert got == brute(rows, k, percent)


def test_components(spark):
    r = random.Random(5)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(r.randrange(100, 160), r.randrange(100, 160)) for _ in range(50)] + [(500, 500 + i) for i in range(1, 80)]
    root = {}
    for a, b in pairs:
        for v in (a, b):
            root.setdefault(v, v)
    for _ in root:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    got = {x.node: x.component for x in M.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {v: c for v, c in root.items() if v in got} and {v for a, b in pairs if a != b for v in (a, b)} == set(got)


def test_empty_table(spark):
    assert M.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_minhash_cut_keeps_true_links():
    assert M.least_alike(100) == M.HALVES * M.ROWS
    assert 0 < M.least_alike(80) < M.least_alike(85) < M.HALVES * M.ROWS


def test_exploded_keys_are_never_broadcast(spark, monkeypatch):
    plans, settle = {}, M.settle

    def seen(df, name):
        out = settle(df, name)
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return out

    monkeypatch.setattr(M, "settle", seen)
    # some of a family link, some do not: buckets with nodes of several components
    rows = family(1, 30, 120, 6, 100) + family(2, 25, 200, 12, 200)
    M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert "bucket-links" in plans
    for name in ("buckets", "bucket-links"):
        assert "SortMergeJoin" in plans[name] and "BroadcastExchange" not in plans[name]

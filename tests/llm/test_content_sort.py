import hashlib
import re

from frostline.llm import content_sort as C


def brute(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", "", t or "")
    groups = {}
    for n, (i, t) in enumerate(rows):
        groups.setdefault(norm(t), []).append((-len(t or ""), i is None, i, n))
    out = []
    for n, (i, t) in enumerate(rows):
        g = sorted(groups[norm(t)], key=lambda x: x[:2] + (x[2] or 0, x[3]))
        out.append((i, g[0][2], len(g), hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_against_brute_force(spark, monkeypatch):
    rows = [(i, "a b c" + " " * (i % 3)) for i in range(400)] + [(1000 + i, f"text {i // 2}") for i in range(60)]
    rows += [(2000, None), (2001, ""), (2002, " \t"), (None, "a b c"), (None, None), (2003, "é\x0b" * 20000), (2004, "é" * 20000), (2005, "a b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as digest", "2 as salt", "3 as keep_id").repartition(3)
    for frequent in (16, 10 ** 9):  # with and without dealing over salts
        monkeypatch.setattr(C, "FREQUENT", frequent)
        found = C.exact_dedup(docs).collect()
        assert sorted(((r.doc_id, r.keep_id, r.group_size, r.digest) for r in found), key=repr) == brute(rows)
        groups = {}
        for r in found:
            groups.setdefault(r.digest, []).append(r.kept)
        assert all(sum(k) == 1 for k in groups.values())


def test_identical_rows_keep_one(spark):
    docs = spark.createDataFrame([(5, "same"), (5, "same"), (7, "other")], "doc_id long, text string")
    assert sorted((r.doc_id, r.kept) for r in C.exact_dedup(docs).collect()) == [(5, False), (5, True), (7, True)]
    assert C.exact_dedup(docs.limit(0)).count() == 0


def test_rows_without_ids_are_dealt_and_many_frequent_texts_are_joined(spark, monkeypatch):
    rows = [(None if i % 3 else i, f"text number {i % 4}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(C, "FREQUENT", 2)
    want = brute(rows)
    for most in (C.SENT_TEXTS, 0):
        monkeypatch.setattr(C, "SENT_TEXTS", most)
        found = C.exact_dedup(docs).collect()
        assert sorted(((r.doc_id, r.keep_id, r.group_size, r.digest) for r in found), key=repr) == want
        assert sum(r.kept for r in found) == 4


def test_no_exchange_after_the_range_partitioning(spark):
    docs = spark.createDataFrame([(5, "same")], "doc_id long, text string")
    n = []
    real = C.settle
    C.settle = lambda df, name: (n.append(df._jdf.queryExecution().executedPlan().toString()) if name == "content-sort" else None, real(df, name))[1]
    try:
        C.exact_dedup(docs).count()
    finally:
        C.settle = real
    assert n[0].count("rangepartitioning") == 1 and "hashpartitioning(head" not in n[0] and "Python" not in n[0] and "Arrow" not in n[0]

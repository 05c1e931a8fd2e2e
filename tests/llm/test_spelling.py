import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from frostline.llm import spelling as S


def one_error(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    form, near = {}, {}
    for w, n in counts.items():
        close = [v for v in counts if one_error(w, v)]
        near[w] = len(close)
        best = min(close, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= 5 * n else None
    def root(w):
        return w if form[w] is None else root(form[w])
    return sorted((w, form[w], root(w), n, near[w], counts.get(form[w])) for w, n in counts.items())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abc", min_size=6, max_size=9), min_size=2, max_size=40, unique=True))
def test_index_finds_all_words_one_error_away(words):
    for m in range(6, 10):
        held = [w for w in words if len(w) in (m, m + 1)]
        index = S.PositionIndex(held, m)
        for w in held:
            want = {v for v in held if one_error(w, v) and min(len(v), len(w)) == m}
            for ending in (False, True):
                got = {v for i, v in enumerate(held) if index.near(w, ending) >> i & 1}
                assert got == {v for v in want if not ending or v[:m // 2] != w[:m // 2]}


@pytest.mark.parametrize("tile,held", [(2048, 200_000), (3, 5)])
def test_query_against_brute_force(spark, monkeypatch, tmp_path, tile, held):
    monkeypatch.setattr(S, "TILE", tile)
    monkeypatch.setattr(S, "HELD_WORDS", held)
    r = random.Random(7)
    base = ["".join(r.choice("abcdéÿ") for _ in range(r.randrange(5, 10))) for _ in range(12)] + ["straße", "ÀÉÎabcd", "prefixa", "prefixb", "prefixc", "prefixd"]
    words = list(base)
    for w in base:
        for _ in range(6):
            i = r.randrange(len(w))
            words += [w[:i] + w[i + 1:], w[:i] + r.choice("abé") + w[i:], w[:i] + r.choice("abé") + w[i + 1:]]
    rows = []
    for doc in range(400):
        rows.append((doc, " ".join(r.choice(base if r.random() < 0.8 else words).upper() if r.random() < 0.2 else r.choice(words) for _ in range(r.randrange(60)))))
    rows += [(1000 + k, "chainaa " * n + "chainab " * (6 * n) + "chainbb " * (36 * n) + "chainbbc " * (200 * n)) for k, n in enumerate([2, 3, 1])]
    rows += [(None, None), (None, "nobody " * 9), (5, ""), (5, "repeat_repeat-repeat×repeat÷repeat"), (5, "repeat_repeat-repeat×repeat÷repeat"), (2000, ("y" * 30000 + " ") * 5 + ("y" * 30001 + " ") * 40)]
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as word", "2 as n", "3 as part").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(x) for x in S.op11_spelling(spark, str(tmp_path)).collect()), key=lambda x: x[0])
    assert got == brute(rows)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert S.group_variants(S.word_counts(df)).count() == 0

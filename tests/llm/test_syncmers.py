import base64
import hashlib
import random

import pytest
import regex
import xxhash

from frostline.llm import syncmers as S


def h(*values):
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(v.encode(), seed=seed)
    return seed


def signed(v):
    return v - (1 << 64) if v >> 63 else v


def is_anchor(words):
    inner = [signed(h(*words[j:j + S.S])) >> S.PLACE_BITS for j in range(S.W)]
    return inner.index(min(inner)) in (0, S.W - 1) and inner[0] != inner[1]


def brute_marks(text):
    """Features of a text, each stretch looked at alone."""
    words, marks, before = regex.findall(S.TOKEN, text), [], 0
    for i in range(len(words) - S.K + 1):
        if is_anchor(words[i:i + S.K]):
            marks.append((h(*words[i:i + S.K]) & 0xFFFFFF) * 256 + (i - before) % 256)
            before = i
    return marks or [(h(text) & 0xFFFFFF) * 256] * bool(text)


def near(a, b):
    a, b = set(a), set(b)
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 1.0


def digest(marks):
    return base64.b64encode(b"".join(m.to_bytes(4, "big") for m in marks)).decode()


def brute(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), signed(h(r[1]))))
    out = []
    for k, (doc, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        cut = len(text) // 3
        edited = text[:len(text) - cut] + after[:cut]
        m, e = brute_marks(text), brute_marks(edited)
        out.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), digest(m), digest(e), near(m, e), near(m, brute_marks(after))))
    return sorted(out, key=repr)


def some_texts():
    r = random.Random(5)
    words = ["".join(r.choice("abcdeéüñ中😀 .,") for _ in range(r.randrange(1, 9))) for _ in range(400)]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    base = prose(120)
    return ([None, "", "x", "ab", "abc", "-" * 500, "- " * 300, "ab\ncd\r\n" * 60, prose(3000), "tiny text of some words", base, base, base + " more", base[:300]]
            + [prose(r.choice([1, 4, 8, 30, 90])) for _ in range(40)] + [base[:k] for k in range(S.K - 2, S.K + 3)]
            + ["unbroken" * 500, "中文没有空格" * 40, " \t\n ", "a.b,c!d?" * 30, "1234567890" * 20 + " word" * 20])


@pytest.mark.parametrize("sample", [32, 1])
def test_query_against_brute_force(spark, monkeypatch, tmp_path, sample):
    monkeypatch.setattr(S, "SAMPLE", sample)
    rows = [(7 * i % 1009, t) for i, t in enumerate(some_texts())]
    rows += [(5000, "same id, one text " * 9), (5000, "same id, another text " * 9), (5001, "a row twice " * 9), (5001, "a row twice " * 9), (None, "no id " * 40), (-3, "below zero " * 30)]
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as next", "2 as found", "3 as splits").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in S.op12_syncmers(spark, str(tmp_path)).collect()), key=repr)
    want = brute(rows)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert all(abs(g[k] - w[k]) < 1e-12 for g, w in zip(got, want) for k in (5, 6))
    alike = {}
    texts = {r[0]: r[1] for r in rows if r[0] not in (5000, None)}
    for g in got:
        if g[0] in texts:
            assert alike.setdefault(texts[g[0]] or "", g[3]) == g[3]
    prose = [g for g in got if g[1] > 200]
    assert sum(g[5] for g in prose) / len(prose) > 0.55


def test_a_passage_gives_the_same_anchors_anywhere():
    r = random.Random(2)
    words = [r.choice(["the", "of", "and", "market", "vote", "rate", "price"]) + r.choice(["", "s", "ed"]) for _ in range(600)]
    place = lambda s: {(i, tuple(s[i:i + S.K])) for i in range(len(s) - S.K + 1) if is_anchor(s[i:i + S.K])}
    assert {(i + 50, v) for i, v in place(words[50:400])} == {(i, v) for i, v in place(words) if 50 <= i <= 400 - S.K}
    # without runs of one token no stretch of 2K - S - 1 tokens is left without an anchor
    at = sorted(i for i, _ in place([f"{w}{i % 7}" for i, w in enumerate(words)]))
    assert max(b - a for a, b in zip(at, at[1:])) <= S.W - 1


def test_empty_table_and_one_row(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert S.op12_syncmers(spark, str(tmp_path)).count() == 0
    text = "only one document, followed by itself, " * 5
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/one/documents.parquet")
    assert [tuple(r) for r in S.op12_syncmers(spark, f"{tmp_path}/one").collect()] == brute([(1, text)])

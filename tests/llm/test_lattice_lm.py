import math
import random
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from frostline.llm import lattice_lm as M
from frostline.llm.common import id_crc

PATH = public_tokenizers.path("piece_bpe_32k.model")


def lattice(counts):
    sp = M.processor(PATH)
    return M.Lattice([sp.id_to_piece(i) for i in range(sp.get_piece_size())], counts)


def segmentations(model, text):
    """Probability and pieces of each segmentation, one by one."""
    score = dict(zip([model.pieces[i] for i in model.places], model.scores))
    if not text:
        yield 1.0, []
    for n in range(1, len(text) + 1):
        head = text[:n]
        if head in score:
            p, used = math.exp(score[head]), [head]
        elif n == 1:
            b = head.encode()
            p, used = math.exp(sum(model.byte_scores[x] for x in b)), [f"<0x{x:02X}>" for x in b]
        else:
            continue
        for q, rest in segmentations(model, text[n:]):
            yield p * q, used + rest


def test_sums_over_all_segmentations():
    model = lattice({"\u2581the": 50.0, "the": 9.0, "e": 30.0, "\u2581t": 11.0, "he": 8.0, "\u2581": 3.0, "ing": 20.0})
    words = ["the", "there", "th", "ing", "a", "é", "x\u4e00y", "\U0001f600", "thing", "the"]
    got = model.words(words)
    into = np.zeros(len(model.pieces))
    model.expected(words, np.arange(1.0, len(words) + 1), into)
    want = Counter()
    for w, g, weight in zip(words, got, range(1, 99)):
        ways = list(segmentations(model, M.BLANK + w))
        total = sum(p for p, _ in ways)
        assert math.isclose(math.log(total), g, rel_tol=1e-9)
        for p, used in ways:
            for u in used:
                want[u] += weight * p / total
    for i, p in enumerate(model.pieces):
        assert math.isclose(into[i], want[p], rel_tol=1e-6, abs_tol=1e-9)


def test_long_words_by_stretches(monkeypatch):
    """The same sums as for short words, whatever the stretch."""
    r = random.Random(3)
    model = lattice({"\u2581the": 50.0, "the": 9.0, "e": 30.0, "\u2581t": 11.0, "he": 8.0, "ing": 20.0, "tion": 7.0})
    words = ["".join(r.choice(["the", "ing", "tion", "e", "q", "é", "\u4e00", "\U0001f600", "zz"]) for _ in range(n)) for n in (1, 2, 7, 40, 90)]
    weights, plain = np.arange(1.0, 6.0), np.zeros(len(model.pieces))
    want = model.words(words)
    model.expected(words, weights, plain)
    for stretch in (1, 7, 64, 1 << 15):
        monkeypatch.setattr(M, "LONG_WORD", 0)
        monkeypatch.setattr(M, "LONG_STRETCH", stretch)
        into = np.zeros(len(model.pieces))
        model.expected(words, weights, into)
        assert np.allclose(model.words(words), want, rtol=1e-11)
        assert np.allclose(into, plain, rtol=1e-8, atol=1e-12)


def test_an_unbroken_megabyte_takes_seconds():
    r = random.Random(4)
    model = lattice({"e": 30.0, "th": 4.0})
    word = "".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789é") for _ in range(1 << 20))
    began = time.process_time()
    total = model.words([word])[0]
    into = np.zeros(len(model.pieces))
    model.expected([word], np.array([2.0]), into)
    assert time.process_time() - began < 60
    # pieces cover each character once, in each of the two occurrences
    letters = np.array([2 if p.startswith("<0x") else 2 * len(p.replace(M.BLANK, "")) for p in model.pieces])
    assert math.isfinite(total) and math.isclose((into * letters).sum() / 2, 2 * len(word), rel_tol=0.05)


def test_scores_of_documents_by_a_plain_recursion(spark):
    """All from the texts: pieces counted and sharpened, the sums over segmentations, with an 80-byte word in every document."""
    line = "-" * 80
    rows = [(i, f"{line} the {w} {line.upper()} of {w}{i % 3}") for i, w in enumerate(["cat", "ran", "thing", "\u00e9t\u00e9", "other", "rate"] * 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.score for r in M.score_documents(docs, id_crc() % 10 == 0, PATH).collect()}
    words = lambda t: t.encode().lower().decode().split()
    train = [t for i, t in rows if zlib.crc32(str(i).encode()) % 10]
    counts = Counter(w for t in train for w in words(t))
    sp = M.processor(PATH)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    plain = {p for p in pieces if not (p[0] == "<" and p[-1] == ">") and M.BLANK not in p[1:]}

    def learn(found):
        whole = sum(found.values()) + len(train) + 0.1 * len(pieces)
        return lambda p: (found[p] + 0.1) / whole, (len(train) + 0.1) / whole

    def sums(word, p):
        text = M.BLANK + word
        alpha, edges = [1.0] + [0.0] * len(text), []
        for j in range(1, len(text) + 1):
            for n in range(1, min(j, 20) + 1):
                piece = text[j - n:j]
                if piece in plain:
                    w, used = p(piece), [piece]
                elif n == 1:
                    used = [f"<0x{b:02X}>" for b in piece.encode()]
                    w = math.prod(p(u) for u in used)
                else:
                    continue
                edges.append((j, n, w, used))
                alpha[j] += alpha[j - n] * w
        return alpha, edges

    found = Counter()
    for w, n in counts.items():
        for piece in sp.encode(w, out_type=str):
            found[piece] += n
    p, _ = learn(found)
    sharper = Counter()
    for word, n in counts.items():
        alpha, edges = sums(word, p)
        share = [0.0] * (len(alpha) - 1) + [float(n)]
        for j, k, w, used in sorted(edges, key=lambda e: -e[0]):
            v = share[j] * alpha[j - k] * w / alpha[j]
            share[j - k] += v
            for u in used:
                sharper[u] += v
    p, end = learn(sharper)
    for i, t in rows:
        want = sum(math.log10(sums(w, p)[0][-1]) for w in words(t)) + math.log10(end)
        assert math.isclose(got[i], want, rel_tol=1e-9), i


@pytest.mark.parametrize("head_words", [M.HEAD_WORDS, 0, 4])
def test_documents(spark, head_words):
    texts = ["The cat and the dog", "the\tDOG\x0b\nran", None, "", "zebra \u00e9t\u00e9", "the " * 20000, "x" * 5000] * 3
    rows = list(enumerate(texts)) + [(None, "the cat"), (4, "again the cat"), (4, "again the cat")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as word", "2 as row", "3 as score")
    got = M.score_documents(docs, id_crc() % 10 == 0, PATH, head_words=head_words).collect()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    words = lambda t: (t or "").encode().lower().split()
    c, texts_n = Counter(), 0
    for i, t in rows:
        if not held(i):
            c.update(words(t))
            texts_n += 1
    total, types = sum(c.values()) + texts_n, len(c) + 1
    base = lambda n: math.log10((n + 0.1) / (total + 0.1 * (types + 1)))
    want = sorted(((i, held(i), len(words(t)) + 1, sum(c[w] > 0 for w in words(t)) + 1, total) for i, t in rows), key=repr)
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in got), key=repr) == want
    by = {(r.doc_id, r.n_tokens): r for r in got}
    for i, t in rows:
        r = by[i, len(words(t)) + 1]
        assert math.isclose(r.base_score, sum(base(c[w]) for w in words(t)) + base(texts_n), rel_tol=1e-9)
        assert math.isfinite(r.score) and r.score < 0
    one, many = by[2, 1].score, by[0, 6].score
    assert many < one


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    r = M.score_documents(docs, id_crc() % 1 == 0, PATH).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (3, 0, 0, 0.0)
    assert M.score_documents(docs.limit(0), id_crc() % 10 == 0, PATH).count() == 0

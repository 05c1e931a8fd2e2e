import hashlib
import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from frostline.llm import bpe as B

PATH = public_tokenizers.path("byte_bpe_50k.json")
C = B.Codec(PATH)
PIECES = [*"aAé'sStT12 \t\n\r\x0b\x0c.,!?-|<>\u0301\u00a0\u3000ßΣ中文\U0001f600\x85\x1c", "<|endoftext|>", "'re", "  ", "the ", " the", "abcdefgh" * 6, "0123" * 9, "----" * 9]


def ids(text):
    return C.tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=60).map("".join), st.sampled_from([5, 20, 90]))
def test_tree_equals_the_library(text, leaf):
    leaves = [C.encode(p) for p in B.halves(text.encode(), leaf)]
    assert C.tree(leaves).tolist() == ids(text) == C.encode(text.encode()).tolist()
    assert C.decode(C.encode(text.encode())) == C.tokenizer.decode(ids(text), skip_special_tokens=False)


@pytest.mark.parametrize("alphabet", ["a", "ab", "abcdefghijklmnopqrstuvwxyz", "0123456789", "-=", "中文字", " ", " \n", "aé", "а"])
def test_unsplit_runs(alphabet):
    r = random.Random(alphabet)
    for n in (200, 5000):
        text = "".join(r.choice(alphabet) for _ in range(n))
        assert C.tree([C.encode(p) for p in B.halves(text.encode(), 64)]).tolist() == ids(text)


def test_join_in_a_run_takes_a_window_only(monkeypatch):
    seen = []
    real = B.Codec.whole
    monkeypatch.setattr(B.Codec, "whole", lambda self, t: (seen.append(len(t)), real(self, t))[1])
    left, right = C.encode(b"ab" * 20000), C.encode(b"ab" * 20000)
    seen.clear()
    C.join(left, right)
    assert sum(seen) < 2000


@pytest.mark.parametrize("leaf", [16384, 100])
def test_documents(spark, leaf):
    rows = [(1, None), (2, ""), (3, "Some words, and more.\n\nIt's <|endoftext|> here"), (3, "z" * 40000), (3, "z" * 40000), (None, "the end " * 4000), (4, " \n" * 9000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as row", "2 as leaf", "3 as ids")
    got = B.encode(docs, PATH, ("ids", "n_tokens", "ids_sha256", "decoded", "decoded_sha256"), leaf)
    want = []
    for i, t in rows:
        x = ids(t or "")
        want.append((i, x, len(x), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest(), t or "", hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(want, key=repr)
    assert B.encode(docs.limit(0), PATH).count() == 0

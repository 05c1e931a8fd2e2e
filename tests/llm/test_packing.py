import random
import zlib
from array import array
from collections import Counter

import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from frostline.llm import packing as P

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def coder():
    return P.RunCoder(PATH)


def test_runs_give_the_ids_of_whole_texts(coder):
    r = random.Random(3)
    parts = list("aAbé'sStT12 \t\n\r\x0b\x0c.,!?-|<>\u0301\u00a0\u3000İßΣσς中文\U0001f600\x85\x1c\x00") + ["<|endoftext|>", "<|STARTOFTEXT|>", "'re", "word", " Words, ", "it's "]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(50))) for _ in range(3000)] + ["", None, "long" * 5000]
    for t, ids in zip(texts, coder.encode(pa.array(texts)), strict=True):
        assert array("I", ids).tolist() == coder.tokenizer.encode(t or "", add_special_tokens=False).ids


def test_words_and_signs_give_the_ids_of_the_run(coder):
    r = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyzABCXYZ" + "".join(map(chr, range(192, 256)))
    signs = [chr(c) for c in range(33, 127) if not chr(c).isalnum() and c != 39]
    runs = ["".join(r.choice(letters) for _ in range(r.randrange(1, 14))) + "".join(r.choice(signs) for _ in range(r.choice([0, 0, 1, 3]))) for _ in range(4000)]
    runs += ["it's", "'s", "a'", "x×y", "÷", "word<|endoftext|>", "word<|", "a1", "12"]
    for run in runs:
        assert array("I", coder.run(run)).tolist() == coder.tokenizer.encode(run, add_special_tokens=False).ids, run


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=12))
def test_plan_places_every_piece_once(histogram):
    used, placed = Counter(), Counter()
    rows = P.plan(histogram, 40)
    ends = {}
    for length, first, per, sequence, offset in sorted(rows, key=lambda r: (r[0], r[1])):
        assert first == used[length]
        later = [r[1] for r in rows if r[0] == length and r[1] > first]
        n = (min(later) if later else histogram[length]) - first
        used[length] += n
        for k in range(n):
            place = (sequence + k // per, offset + k % per * length)
            placed[place] += 1
            ends.setdefault(place[0], []).append((place[1], place[1] + length))
    assert used == Counter(histogram) and (not placed or max(placed.values()) == 1)
    for spans in ends.values():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] <= 40 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


def test_counts_per_length_stay_few(spark):
    """The table of counts holds a row for each bucket of a length, not for each piece."""
    rows = [(i, 0, 2048 if i % 2 else 1 + i % 2000, i, 5) for i in range(9000)]
    parts = spark.createDataFrame(rows, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")
    packed = P.pack(parts).collect()
    whole = [r.sequence_id for r in packed if r.length == 2048]
    assert len(packed) == 9000 and len(set(whole)) == 4500
    spans = {}
    for r in packed:
        spans.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in spans.values():
        s.sort()
        assert s[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(s, s[1:])) and sum(s[-1]) <= 2048


def test_fill_is_closest_to_capacity():
    r = random.Random(1)
    for _ in range(200):
        counts = {r.randrange(1, 30): r.randrange(1, 4) for _ in range(5)}
        lengths = sorted(counts, reverse=True)
        sums = {lengths[0]}
        for n in lengths:
            for _ in range(counts[n] - (n == lengths[0])):
                sums |= {s + n for s in sums}
        chosen = P.best_fill(counts, lengths, 40)
        assert sum(n * c for n, c in chosen.items()) == max(s for s in sums if s <= 40)
        assert all(c <= counts[n] for n, c in chosen.items())


@pytest.mark.parametrize("bucket_rows", [2000, 3])
def test_round_trip(spark, coder, monkeypatch, bucket_rows):
    monkeypatch.setattr(P, "BUCKET_ROWS", bucket_rows)
    texts = [None, "", "a b c", "word " * 7000] + ["hello world, it is me"] * 40 + ["x " * (i * 13 % 300) for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(2, "a b c"), (None, "no id")], "doc_id long, text string").selectExpr("*", "1 as length", "2 as rank")
    got = P.pack(P.pieces(docs, PATH, with_ids=True))
    rows = got.collect()
    by_sequence, by_doc = {}, {}
    for r in rows:
        assert len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault((r.doc_id, r.doc_tokens), {})[r.start] = bytes(r.ids)
    for spans in by_sequence.values():
        spans.sort()
        at = 0
        for offset, length in spans:
            assert offset == at
            at += length
        assert at <= 2048
    for n, t in enumerate(texts):
        want = array("I", coder.tokenizer.encode(t or "", add_special_tokens=False).ids + [1])
        assert b"".join(v for _, v in sorted(by_doc[n, len(want)].items())) == want.tobytes()
    total = sum(r.length for r in rows)
    assert len(by_sequence) <= -(-total // 2048) + 1
    whole = {r.sequence_id: bytes(r.ids) for r in P.sequences(got).collect()}
    assert sum(map(len, whole.values())) == 4 * total
    assert P.pack(P.pieces(docs.limit(0), PATH)).count() == 0

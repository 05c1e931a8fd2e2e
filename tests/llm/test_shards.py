import zlib
from collections import Counter

import pytest

from frostline.llm import shards as S


@pytest.mark.parametrize("bucket_rows", [2000, 7])
def test_shards_are_even_and_mixed(spark, monkeypatch, bucket_rows):
    monkeypatch.setattr(S, "BUCKET_ROWS", bucket_rows)
    monkeypatch.setattr(S, "SPAN", 3 if bucket_rows == 7 else 1000)
    rows = [(i, "t" * (i % 5), "hot" if i < 400 else f"s{i % 7}" if i < 700 else f"own{i}") for i in range(1000)]
    rows += [(None, None, None), (5, "", "hot"), (5, "", "hot"), (1001, "é" * 50000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as shard", "2 as rank")
    got = S.interleave(docs, 8).collect()
    assert len(got) == len(rows)
    sizes = Counter(r.shard for r in got)
    assert set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    hot = Counter(r.shard for r in got if r.doc_id is not None and r.doc_id < 400)
    assert max(hot.values()) - min(hot.values()) <= 3
    texts = {i: t for i, t, _ in rows}
    for r in got:
        body = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(body) + 16, zlib.crc32(body))
    again = S.interleave(docs.repartition(3), 8).collect()
    assert sorted((r.doc_id or -1, r.shard, r.slot) for r in got) == sorted((r.doc_id or -1, r.shard, r.slot) for r in again)


def test_empty_table(spark):
    assert S.interleave(spark.createDataFrame([], "doc_id long, text string, source string"), 4).count() == 0

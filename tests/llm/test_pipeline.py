import random

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as P
from conftest import SMALL
from frostline.llm import langid
from test_content_sort import brute as exact
from test_minhash import brute as near

COMMON = "the of and to in is that for it with as was".split()


def rows():
    r = random.Random(4)
    line = lambda: " ".join(r.choice(COMMON) if r.random() < 0.3 else f"word{r.randrange(10 ** 5)}" for _ in range(15))
    text = lambda: "\n".join(line() for _ in range(12))
    base = [(i, text(), "en", f"s{i % 3}", 0) for i in range(40)]
    out = base + [(100 + i, base[i][1].replace("\n", " \n"), "en", "s1", 0) for i in range(6)]
    out += [(200 + i, base[i][1] + " tail", "en", "s1", None) for i in range(6)]
    out += [(300, None, None, None, None), (301, "too short", "en", "s", 0), (302, "sign%%% word$$$ " * 40, "en", "s", 0), (None, text(), "en", None, 0)]
    return out + [base[3], base[3]]


def test_stages_against_brute_force(spark, tmp_path):
    data = rows()
    path = str(tmp_path / "in")
    (spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 as `_row`", "2 as kept")
     .repartition(2).write.parquet(f"{path}/documents.parquet"))
    docs = spark.read.parquet(f"{path}/documents.parquet")
    good = sorted([(d[0], d[1]) for d in data if d[0] not in (300, 301, 302)], key=repr)
    quality = P.quality_rules(spark, docs, path)
    assert quality.columns == docs.columns and sorted(((r.doc_id, r.text) for r in quality.collect()), key=repr) == good
    assert sorted(((r.doc_id, r.text) for r in P.language_id(spark, quality, path).collect()), key=repr) == good
    unique = {(i, t) for (i, t) in good if i == next(k for j, k, *_ in exact(good) if j == i)}
    left = P.exact_dedup(spark, quality, path)
    assert left.columns == docs.columns and sorted(((r.doc_id, r.text) for r in left.collect()), key=repr) == sorted(unique, key=repr)
    kept = {i for i, _, _, k in near(sorted(unique, key=repr), 5, 80) if k} | {None}
    last = P.near_dedup(spark, left, path)
    assert last.columns == docs.columns and {r.doc_id for r in last.collect()} == kept and last.count() == len(kept)
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: len(tok.encode(t, add_special_tokens=False).ids) + 1 for i, t in unique if i in kept}
    packed = P.run(spark, path).collect()
    total = {}
    for r in packed:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
        assert r.doc_tokens == want[r.doc_id]
    assert total == want


def test_empty_and_small_tables(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
    assert langid.keep_known(docs.limit(0)).count() == 0
    assert P.run(spark, SMALL).count() > 0

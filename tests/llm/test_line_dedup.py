import hashlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from frostline.llm import line_dedup as L

WS = " \t\n\x0b\x0c\r"
LONG = "This line is found in many documents, over and over again."


def brute(rows, min_chars=40, min_docs=5):
    holders = defaultdict(set)
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(WS))
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= min_chars:
                holders[key(x)].add(i)
    keep = {k: max((i for i in h if i is not None), default=None) for k, h in holders.items() if len(h) >= min_docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        left = [x for x in lines if keep.get(key(x)) is None or keep[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(left), hashlib.sha256("\n".join(left).encode()).hexdigest()))
    return sorted(out, key=repr)


def digest(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in df.collect()), key=repr)


@pytest.mark.parametrize("shard_lines", [500_000, 2])
def test_against_brute_force(spark, shard_lines):
    rows = [(i, f"{LONG}\nown line of document number {i} that nobody else has\n" + ("\t" + LONG.upper() + " \r" if i % 2 else "short")) for i in range(9)]
    rows += [(100 + i, f"common passage {i % 4} that goes on for more than forty characters\nx\n\n") for i in range(30)]
    rows += [(200, None), (201, ""), (None, LONG), (202, "é" * 40), (203, "é" * 39), (204, "\n".join([LONG] * 500)), (204, "\n".join([LONG] * 500))]
    rows += [(300 + i, "é" * 40 + "\x0b") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n_lines", "'x' as dropped", "2 as text_hash")
    assert digest(L.line_dedup(docs, shard_lines=shard_lines)) == brute(rows)


def test_repeated_rows_are_one_document(spark, tmp_path):
    """Three documents, each row twice, share a line: found in three documents, not in six."""
    rows = [(i, f"{LONG}\nown {i}") for i in range(3) for _ in range(2)] + [(10 + i // 2, "another line that is long enough to be looked at") for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = digest(L.line_dedup(docs))
    assert got == brute(rows)
    assert all(n == 0 for i, _, n, _ in got if i < 10) and all(n == 1 for i, _, n, _ in got if 10 <= i < 14)
    # the SQL has one row per doc_id: without the repeats it gives the same
    con = duckdb.connect()
    con.execute(f"create view documents as select distinct * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    once = {tuple(r) for r in L.op1_line_dedup(spark, str(tmp_path)).collect()}
    assert once == set(con.execute(L.OP1_SQL).fetchall())


def test_one_line_in_all_documents_is_dealt_over_salts(spark):
    rows = [(i, f"{LONG}\nown line of document number {i} that nobody else has") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert digest(L.line_dedup(docs)) == brute(rows)


def test_empty_table_and_lines_without_ids(spark):
    assert L.line_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(None, LONG)] * 6
    assert digest(L.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"))) == brute([(None, LONG)] * 6)


def test_perfect_hash_is_minimal_and_refuses_others():
    pairs = L.hash_pairs([b"key %d" % i for i in range(5000)])
    index = L.PerfectHash.load(L.build_index(pairs, np.arange(5000), np.arange(5000) * 7))
    place = index.find(pairs)
    assert sorted(place) == list(range(5000))
    assert (index.arrays[2][place] == np.arange(5000) * 7).all()
    assert (index.find(L.hash_pairs([b"other %d" % i for i in range(20000)])) == -1).all()

"""The registered queries against their SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import SMALL
from frostline.llm.queries import ORACLE, QUERIES


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert {*QUERIES, "pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.execute(f"create view {table} as select * from read_parquet('{SMALL}/{table}.parquet')")
    want = con.execute(ORACLE[name])
    columns = sorted(d[0] for d in want.description)
    order = [columns.index(d[0]) for d in want.description]
    rows = []
    for r in want.fetchall():
        row = [None] * len(columns)
        for k, v in zip(order, r):
            row[k] = v
        rows.append(tuple(row))
    got = QUERIES[name](spark, SMALL)
    assert sorted(got.columns) == columns
    assert sorted((tuple(r) for r in got.select(*columns).collect()), key=repr) == sorted(rows, key=repr)


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n[:4] not in ("op11", "op13")))
def test_one_row_per_document_or_piece(spark, name):
    table = "pages" if name.startswith("op9") else "documents"
    n = spark.read.parquet(f"{SMALL}/{table}.parquet").count()
    got = QUERIES[name](spark, SMALL).count()
    assert got >= n if name.startswith("op8") else got == n

"""Registered queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
LLM = [n for n in entry.queries() if n.startswith("op") and n[2].isdigit() or n == "pipeline"]
CORE = [n for n in entry.queries() if n not in LLM]


def plain(v):
    if v is None:
        return "NULL"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return "NULL" if v != v else f"{float(v):.6g}"
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", CORE)
def test_core_query(name, spark, duck):
    df = entry.queries()[name](spark, SF)
    rows = df.collect()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert len(set(df.columns)) == len(df.columns)
        return
    rel = duck.execute(sql)
    names = [d[0] for d in rel.description]
    assert sorted(names) == sorted(df.columns)
    order = [names.index(c) for c in df.columns]
    want = sorted("|".join(plain(r[k]) for k in order) for r in rel.fetchall())
    assert sorted("|".join(map(plain, r)) for r in rows) == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_data_is_there():
    assert all(os.path.exists(f"{SF}/{t}.parquet") for t in TABLES)

"""Ranked search against a plain loop over exact integers."""

import math
import re
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from corpusloom.llm.ranked_search import ranked_search

SF = "/root/testdata/sf0.001"
PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in PATTERN.findall(text or "")]


def brute(docs, items, k=10):
    counted = [(i, terms(t)) for i, t in docs]
    counted = [(i, len(w), Counter(w)) for i, w in counted if w]
    n_docs, total = len(counted), sum(n for _, n, _ in counted)
    df = Counter(t for _, _, c in counted for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
    asked = {}
    for i, t in set(items):
        asked.setdefault(i, Counter()).update(terms(t))
    out = []
    for i, wanted in asked.items():
        found = []
        for d, n, c in counted:
            m = 25 + (75 * n * n_docs) // total
            s = sum(times * weight[t] * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, times in wanted.items() if t in c)
            if s > 0:
                found.append((s, d))
        found.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        out += [(i, rank, d, s) for rank, (s, d) in enumerate(found[:k], 1)]
    return out


def rows(df):
    return sorted(map(tuple, df.collect()), key=lambda x: tuple((v is None, v or 0) for v in x))


DOCS = [
    (1, "Alpha beta beta, gamma."), (2, "alpha"), (3, None), (4, ""), (5, "..."), (6, "ALPHA Ünder under Über"),
    (7, "beta " * 3_000 + "delta"), (8, "alpha beta"), (8, "alpha beta"), (None, "delta beta"), (9, "x1 2y é"),
] + [(100 + n, "tie word") for n in range(40)]
ITEMS = [(1, "alpha beta"), (2, "tie"), (3, None), (4, ""), (5, "nowhere"), (6, "beta beta delta"), (6, "beta beta delta"), (7, "ünder Über"), (7, "alpha"), (None, "gamma é")]


@pytest.mark.parametrize("max_pairs", [1_000_000, 4])
def test_equals_a_loop(spark, max_pairs):
    docs = spark.createDataFrame([(i, t, i, "x") for i, t in DOCS], "doc_id long, text string, id long, n string").repartition(5)
    items = spark.createDataFrame([(i, t, 1) for i, t in ITEMS], "item_id long, text string, rank int")
    got = ranked_search(docs, items, max_pairs=max_pairs)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    want = sorted(brute(DOCS, ITEMS), key=lambda x: tuple((v is None, v or 0) for v in x))
    assert rows(got) == want
    assert [d for i, _, d, _ in want if i == 2] == list(range(100, 110))


def test_empty_tables(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert ranked_search(docs.limit(0), items).collect() == []
    assert ranked_search(docs, items.limit(0)).collect() == []
    assert ranked_search(docs.where("text = ''"), items).collect() == []


def test_query_equals_its_sql(spark):
    got = entry.queries()["op11_ranked_search"](spark, SF)
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(entry.oracle_sql()["op11_ranked_search"]).fetchall()
    assert rows(got.select("item_id", "rank", "doc_id", "score")) == sorted(want)
    assert want

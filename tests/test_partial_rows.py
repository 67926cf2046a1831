"""Functions that the tables do not drive into every corner: names, answers, spelling, modes, memory, pruning, exports, labels."""

import csv
import json

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import graph as G
from corpusloom.operators import history as H
from corpusloom.operators import recommend as R
from corpusloom.operators import search as S
from corpusloom.operators import vectors as V


def one_column(spark, values, column, kind="string"):
    df = spark.createDataFrame([(n, v) for n, v in enumerate(values)], f"n int, v {kind}")
    return [r[1] for r in df.select("n", column(F.col("v")).alias("x")).orderBy("n").collect()]


def test_names(spark):
    names = [None, "  ", "a.txt", "word " * 20 + "end.pdf", "w" * 60 + ".pdf", "no-extension-" * 5, "x." + "e" * 50]
    got = one_column(spark, names, lambda c: T.fitted_name(c, 40))
    assert got[:3] == ["unnamed", "unnamed", "a.txt"]
    assert got[3] == "word word word word word word word.pdf" and got[4] == "w" * 35 + ".pdf"
    assert got[5] == "no-extension-no-extension-no-extension" and len(got[6]) == 40
    assert one_column(spark, ["/a/b.TXT", "c:\\d\\e.tar.GZ", ".hidden", "plain", None], lambda c: T.extension_of(T.base_name(c))) == [".txt", ".gz", "", "", None]
    assert one_column(spark, ["Über-Maß 2", "ПРИВЕТ мир", ""], lambda c: T.case_convention(c, "snake")) == ["über_maß_2", "привет_мир", ""]
    assert one_column(spark, ["aB c"], lambda c: T.case_convention(c, "odd")) == ["aB c"]
    assert one_column(spark, ["e\u0301", None], T.composed) == ["é", None]
    assert one_column(spark, ["a\0b \n c ", None], lambda c: T.normal_text(c, 4)) == ["ab c", None]


def test_dates(spark):
    subjects = ["report 2024-01-02", "report_20240102", "x - 2023-12-31_20231231 ", "2024-01-02", "plain", None]
    assert one_column(spark, subjects, T.without_date) == ["report", "report", "x", "2024-01-02", "plain", None]
    names = ["scan 2024-02-30 x", "20231231.pdf", "99999999", "none"]
    later = F.lit("2020-05-05").cast("timestamp")
    assert one_column(spark, names, lambda c: F.date_format(T.effective_date(c, F.lit(None).cast("timestamp"), later), "yyyy-MM-dd")) == ["2020-05-05", "2023-12-31", "2020-05-05", "2020-05-05"]


def test_answers(spark):
    said = ['{"category":"a","keywords":["x",""," ",3,{"k":1},null],"confidence":12.5}', '{"category":5,"confidence":true}', '{"category":{"a":1},"keywords":{},"confidence":-1}', '{"confidence":101}', "{", "", None, '"text"', '{"confidence":100}']
    got = [(r["category"], r["keywords"], r["confidence"]) for r in one_column(spark, said, T.validated_analysis)]
    assert got[0] == ("a", ["x"], 12.5)
    assert all(g == ("document", [], 70.0) for g in got[1:8])
    assert got[8] == ("document", [], 100.0)


def test_spelling(spark):
    words = [("invoise",), ("teh",), ("which",), ("Invoice",), ("documant",), ("presentaton",), ("zzzzzz",), ("kwarterlee",), (None,), ("invoise",)]
    known = [("invoice", 5), ("invoke", 6), ("document", 7), ("presentation", 8), ("quarterly", 9), ("the", 1), ("kwartarely", 10)]
    got = {r["word"]: r["fixed"] for r in S.spelling(spark.createDataFrame(words, "word string"), spark.createDataFrame(known, "word string, place int"), stop=("which",)).collect()}
    assert got == {"invoise": "invoice", "teh": "teh", "which": "which", "Invoice": "Invoice", "documant": "document", "presentaton": "presentation", "zzzzzz": "zzzzzz", "kwarterlee": "kwartarely"}


def test_modes(spark):
    q = spark.createDataFrame([(1, "alpha", [1.0]), (2, "beta", None), (3, "x", [1.0]), (4, None, [1.0])], "query long, text string, embedding array<double>")
    search = lambda name: lambda some: some.select("query", F.lit(len(name)).cast("long").alias("id"), F.lit(0.5).alias("score"), F.lit(1).alias("rank"))
    for mode, want in (("bm25", {(1, "bm25"), (2, "bm25")}), ("vector", {(1, "vector"), (2, "bm25")}), ("hybrid", {(1, "hybrid"), (2, "bm25")})):
        found, errors = S.by_mode(q, mode, keyword=search("bm25"), vector=search("vector"), hybrid=search("hybrid"))
        assert {(r["query"], r["mode"]) for r in found.collect()} == want
        assert {r["query"] for r in errors.collect()} == {3, 4}
    with pytest.raises(ValueError, match="no such mode"):
        S.by_mode(q, "magic", keyword=None, vector=None, hybrid=None)


def test_memory(spark):
    s = spark.createDataFrame([(1, "Bills", ".PDF", 0.5), (1, "Photos", ".PDF", 0.5), (2, "Bills", "txt", 0.95), (3, "Bills", None, 0.05)], "file long, folder string, ext string, score double")
    rules = spark.createDataFrame([("pdf", "bills"), (".txt", "Bills")], "ext string, folder string")
    memory = spark.createDataFrame([(1, "PHOTOS", 0.8), (1, "photos", 0.4), (3, "Other", 5.0)], "file long, folder string, score double")
    got = {(r["file"], r["folder"]): round(r["score"], 6) for r in R.adjusted_by_memory(s, rules, memory).collect()}
    assert got == {(1, "Bills"): 0.58, (1, "Photos"): 0.52, (2, "Bills"): 1.0, (3, "Bills"): 0.0}
    plain = {(r["file"], r["folder"]): round(r["score"], 6) for r in R.adjusted_by_memory(s, rules).collect()}
    assert plain == {(1, "Bills"): 0.7, (1, "Photos"): 0.4, (2, "Bills"): 1.0, (3, "Bills"): 0.05}


def test_pruning(spark):
    day = 86_400.0
    rows = [(f"p{n}", n, 0.5, 1_000 * day - n * day) for n in range(1, 21)] + [("old", 99, 1.0, 1_000 * day - 181 * day)]
    p = spark.createDataFrame(rows, "key string, count long, confidence double, last double")
    got = {(r["key"], r["reason"]) for r in R.pruned_patterns(p, 1_000 * day, capacity=20).collect()}
    assert got == {("old", "stale"), ("p1", "low"), ("p2", "low")}
    assert {r["key"] for r in R.pruned_patterns(p, 1_000 * day, capacity=21).collect()} == {"old"}


def test_exports(spark):
    rows = [('a "q", b.txt', "/x/\\y", None, None, ["k;1", 'l"m'], "line\nnext é", 0)]
    df = spark.createDataFrame(rows, "file_name string, path string, category string, confidence int, tags array<string>, subject string, ts long")
    line = H.exported(df, "csv").first()["line"]
    cells = json.loads(f"[{line}]")
    assert cells == ['a "q", b.txt', "/x/\\y", "", "", 'k;1; l"m', "line\nnext é", "1970-01-01T00:00:00.000Z"]
    assert len(cells) == len(H.EXPORTED) and "\n" not in line and len(next(csv.reader([line.replace('\\"', '""')]))) == 7
    assert json.loads(H.exported(df, "json").first()["line"])["keywords"] == ["k;1", 'l"m']


def test_upsert_report_and_hashes(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, "B"), (3, None), (4, "d")], "k long, v string")
    table, told = H.upsert_report(old, new, "k", F.length("v") > 0)
    assert {tuple(r) for r in table.collect()} == {(1, "a"), (2, "B"), (4, "d")}
    assert {tuple(r) for r in told.collect()} == {(2, "updated"), (3, "invalid"), (4, "inserted")}
    files = spark.createDataFrame([(1, "x", 5), (2, "x", 9), (3, "x", 9), (4, "y", None)], "doc_id long, c string, ts long")
    hits = H.lookup_hashes(files, files.select(F.md5("c").alias("hash")), F.md5("c"))
    assert sorted(r["doc_id"] for r in hits.collect()) == [3, 4]


def test_diagnostics(spark):
    v = spark.createDataFrame([(1, [1.0, 2.0]), (2, [0.0, 0.0]), (3, []), (4, None), (5, [1.0]), (6, [float("nan"), 1.0]), (7, [1.0, None])], "vec_id long, embedding array<double>")
    files = spark.createDataFrame([(n,) for n in (1, 2, 3, 90, 91, 91)], "vec_id long")
    r = V.diagnostics(v, files, 2, most=3).first().asDict()
    assert r == {"total": 7, "with_vector": 5, "without_vector": 2, "zero": 1, "wrong_size": 1, "orphaned": 4, "missing": 2, "eligible": 1, "sample": [2, 3, 4]}
    none = V.diagnostics(v.limit(0), files.limit(0), 2).first()
    assert none["total"] == none["missing"] == 0 and none["sample"] == []


def test_labels_and_terms(spark):
    rows = [(0, n, "Bills", ["Tax", "tax", "2024", "x"]) for n in range(3)] + [(1, 10, None, ["one", "two"]), (2, 20, "", []), (3, 30, "Trips", None)]
    df = spark.createDataFrame(rows, "cluster int, id long, category string, tags array<string>")
    assert {tuple(r) for r in G.cluster_labels(df).collect()} == {(0, "Tax Bills", "medium"), (1, "one, two", "low"), (2, "Cluster 3", "low"), (3, "Trips", "medium")}
    m = spark.createDataFrame([("a", "solar", "wind wind shared"), ("a", None, "shared"), ("b", "coal", "shared wind")], "cluster string, tags string, text string")
    got = {(r["cluster"], r["term"]): round(r["score"], 4) for r in G.cluster_terms(m, {"tags": 3, "text": 1}).collect()}
    assert got == {("a", "solar"): round(3 * 0.405465, 4), ("b", "coal"): round(3 * 0.405465, 4)}

import json

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import documents as D
from corpusloom.functions import text as T
from corpusloom.operators import graph as G
from corpusloom.operators import recommend as R
from corpusloom.operators import search as S
from corpusloom.operators import vectors as V


@pytest.mark.parametrize(
    ("broken", "want"),
    [
        ('```json\n{"a": 1,}\n```', {"a": 1}),
        ('x {"a": "b" "c": 2} y', {"a": "b", "c": 2}),
        ('{"a": "line\nbreak"', {"a": "line\nbreak"}),
        ('{"a": [1, 2, {"b": "c"', {"a": [1, 2, {"b": "c"}]}),
        ('{"a": "}"} trailing }', {"a": "}"}),
        ("[1, 2,]", [1, 2]),
        ('{"a":', {"a": None}),
    ],
)
def test_repair(broken, want):
    assert json.loads(D.repaired(broken)) == want


def test_repair_gives_up():
    assert D.repaired(None) is None and D.repaired("no json") is None


def test_outline_and_passages():
    text = "# Title\nbody\n1.2 Part two\nALL CAPS HEAD\n# title\n" + "para words here.\n\n" * 3_000
    assert D.outline(text) == ["Title", "1.2 Part two", "ALL CAPS HEAD"]
    got = D.representative(text, 4_000)
    assert got.startswith("Title\n1.2") and len(got) < 4_300 and D.representative("short") == "short" and D.representative(None) == ""


def test_phonetic():
    assert [T.phonetic(w) for w in ("Robert", "Rupert", "Pfister", "", "a", "Tymczak")] == ["R163", "R163", "P123", "", "A000", "T522"]


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column).first()[0]


def test_text_functions(spark):
    c = F.col("x")
    assert one(spark, T.clean(c), x="a\tb\0c  d\n\n") == "a b c d"
    assert one(spark, T.preview(c, 10), x="abcdefgh ijkl") == "abcdefgh..."
    assert one(spark, T.camel(c), x="Hello big-world 2") == "helloBigWorld2"
    assert one(spark, T.as_list(c), x='["a", " b ", ""]') == ["a", "b"] and one(spark, T.as_list(c), x="a, b,,c") == ["a", "b", "c"]
    assert one(spark, T.distinct_keywords(F.split(c, ",")), x="Tax,tax,  ,Law") == ["Tax", "Law"]
    assert one(spark, T.html_text(c), x="<script>x</script><p>a&amp;lt;b</p>") == "a<b"


def test_chunks(spark):
    docs = spark.createDataFrame([(1, "a" * 2_500), (2, ""), (3, None), (4, "  x  ")], "doc_id long, text string")
    got = [(r["id"], r["index"], r["start"], r["end"]) for r in S.chunks(docs).orderBy("id", "index").collect()]
    assert got == [(1, 0, 0, 1000), (1, 1, 800, 1800), (1, 2, 1600, 2500), (4, 0, 2, 3)]


def test_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.8, 0.6]), (3, [0.0, 1.0]), (4, [0.0, 0.0])], "vec_id long, embedding array<double>")
    top = V.top_k(v, v.where("vec_id = 1").select(F.col("vec_id").alias("query"), "embedding"), 2).collect()
    assert sorted((r["vec_id"], round(r["score"], 3), r["rank"]) for r in top) == [(1, 1.0, 1), (2, 0.8, 2)]
    for tile in (1, 2, 10):
        assert sorted((r["a"], r["b"]) for r in V.similar_pairs(v, 0.5, tile=tile).collect()) == [(1, 2), (2, 3)]
    a = F.col("a")
    assert one(spark, V.cosine(a, F.array(F.lit(0.0), F.lit(0.0))), a=[1.0, 0.0]) == 0.0
    assert V.kmeans(v, 2).select("cluster").distinct().count() == 2


def test_components(spark):
    n = 40
    chain = [(i, i + 1) for i in range(n)] + [(100, 101), (101, 102), (102, 100)]
    got = {r["node"]: r["component"] for r in G.connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(n + 1), 0), 100: 100, 101: 100, 102: 100}


def test_learning_and_names(spark):
    f = spark.createDataFrame([("k", i, i, ok) for i, ok in enumerate([True, True, False])] + [("z", 1, 1, True), ("z", 2, 2, False), ("z", 3, 3, False), ("z", 4, 4, False)], "key string, ts long, id long, accepted boolean")
    got = {r["key"]: (r["count"], r["confidence"], r["alive"]) for r in R.learned_patterns(f).collect()}
    assert got == {"k": (2, 0.45, True), "z": (0, 0.0, False)}
    n = spark.createDataFrame([("d", "A.txt", 1), ("d", "a.txt", 2), ("d", "a-2.txt", 3), ("e", "a.txt", 4), ("d", "a.txt", 5)], "dir string, name string, i long")
    names = [r["unique_name"] for r in R.unique_names(n, dir_col="dir", name_col="name", order_col="i").orderBy("i").collect()]
    assert names == ["A.txt", "a-3.txt", "a-2.txt", "a.txt", "a-4.txt"]


def test_fusion_rules(spark):
    r = spark.createDataFrame([(1, 10, 5.0, 1), (1, 11, 3.0, 2), (1, 12, 1.0, 3)], "query long, id long, score double, rank int")
    assert [x["score"] for x in S.normalised(r).orderBy("id").collect()] == [1.0, 0.5, 0.0]
    fused = S.hybrid(r, r, r, k=2).orderBy("rank").collect()
    assert [(x["id"], x["score"]) for x in fused] == [(10, 1.0), (11, 0.5)]
    order = [x["id"] for x in S.rerank(r, F.when(F.col("id") == 12, 9.0), 3).orderBy("new_rank").collect()]
    assert order == [12, 10, 11]


def test_analyser_seam(spark):
    def analyse(text, name):
        if "bad" in text:
            raise ValueError(name)
        return {"category": text.split()[0], "keywords": text.split(), "confidence": 0.9} if text else None

    df = spark.createDataFrame([("tax forms", "a.pdf"), ("bad one", "Tax.pdf"), (None, None)], "text string, name string")
    got = df.withColumn("a", D.document_analyser(analyse)("text", "name"))
    rule = R.rule_category(F.col("name"), F.lit("pdf"), {"Tax": ["tax"]}, {"pdf": "Papers"})
    assert [tuple(r) for r in got.select(F.coalesce("a.category", rule), "a.keywords", "a.confidence").collect()] == [("tax", ["tax", "forms"], 0.9), ("Tax", None, None), ("Papers", None, None)]


def test_keywords_make_their_words_once(spark, capsys):
    from pyspark.sql import functions as F

    from corpusloom.functions import text as T

    df = spark.createDataFrame([("Tax a TAX b tax A c",), ("",), (None,)], "t string")
    got = df.select(T.distinct_keywords(F.regexp_extract_all("t", F.lit("([A-Za-z]+)"), 1), 3).alias("k"))
    assert [r["k"] for r in got.collect()] == [["Tax", "a", "b"], [], None]
    df.createOrReplaceTempView("keyword_texts")
    plan = spark.table("keyword_texts").where("t <> ''").select(T.distinct_keywords(F.regexp_extract_all("t", F.lit("([A-Za-z]+)"), 1), 3).alias("k"))
    plan.explain(True)
    analysed = capsys.readouterr().out.split("== Physical Plan ==")[1]
    assert analysed.count("regexp_extract_all") == 1

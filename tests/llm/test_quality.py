"""Quality rules: counts against plain loops, the model by held-out accuracy and calibration."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from corpusloom.llm.quality import COUNTS, QualityModel, counts_of, features, fit_quality, repeated_words, score_quality
from corpusloom.session import table


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {p for i, w in enumerate(windows) if windows.count(w) > 1 for p in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


TEXTS = [
    None, "", " \t\n", "a", "a b c", "a b c a b c", "a a a a", "x # y\nx # y\n\n \n \nx # y", "é ü z | <b>\x1c",
    "one two three four\r\none two three four\r\n", "\u0085 \x0b\x0c w w w w w", "ab " * 200, "👍 ok 👍 ok 👍 ok",
]


@pytest.mark.parametrize("text", TEXTS)
def test_counts(text):
    assert counts_of(text) == plain_counts(text)


def test_repeated_words_on_many_vocabularies():
    rng = np.random.default_rng(1)
    for n in range(60):
        words = [b"w%d" % x for x in rng.integers(1, 2 + n // 4, size=n)]
        want = {p for i in range(n - 2) for j in range(n - 2) if i != j and words[i : i + 3] == words[j : j + 3] for p in range(i, i + 3)}
        assert repeated_words(words) == len(want)


def test_features():
    assert len(features(None)[0]) == len(features("")[0]) == 0
    a, b = features("Some Words here"), features("some words here")
    assert (a[0] == b[0]).all()
    assert abs(np.linalg.norm(a[1]) - 1) < 1e-6
    assert set(features("some words")[0]) < set(b[0])
    assert len(features("x" * 300_000)[0]) and len(features("ab " * 100_000)[0])


def test_without_labels_only_the_limits_decide(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(None, "word " * 10, "y", 2), (50, " ".join(f"w{n}" for n in range(60)), "z", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string, quality int")
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = fit_quality(docs, none)
    out = score_quality(docs, model)
    assert len({c.lower() for c in out.columns}) == len(out.columns)
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        n = plain_counts(r["text"])
        assert tuple(r[c] for c in COUNTS) == n
        assert r["base_failed"] == (n[0] < 50 or 100 * n[4] > 50 * n[0])
        assert r["kept"] == (not r["base_failed"]) and r["quality"] == 1
    assert score_quality(docs.limit(0), model).collect() == []
    assert fit_quality(docs.limit(0), none).weights is None


def test_query_and_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = entry.queries()["op13_quality"](spark, sf)
    assert set(got.columns) == {"doc_id", *COUNTS, "quality", "base_failed", "kept"}
    rows = {r["doc_id"]: r for r in got.collect()}
    texts = {r["doc_id"]: r["text"] for r in table(spark, sf, "documents").collect()}
    assert rows.keys() == texts.keys()
    for i in list(texts)[::7]:
        if len(texts[i] or "") < 20_000:
            assert tuple(rows[i][c] for c in COUNTS) == plain_counts(texts[i])
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "labels")
    train = F.crc32(F.col("doc_id").cast("string")) % 4 != 0
    model = fit_quality(docs, labels.where(train))
    held = score_quality(docs.join(labels.where(~train), "doc_id"), model).withColumnRenamed("quality", "p").join(labels.select("doc_id", F.col("quality").alias("y")), "doc_id").where(~F.col("base_failed")).toPandas()
    wrong_good = held[(held.y == 1) & ~held.kept]
    junk = held[held.y == 0]
    assert len(junk) > 40 and (~junk.kept).mean() > 0.9
    assert len(wrong_good) <= 0.01 * (held.y == 1).sum()
    assert ((held.p - held.y) ** 2).mean() < 0.02  # calibrated: the Brier score


def test_model_is_sent_as_it_is(spark):
    docs = spark.createDataFrame([(1, "good " * 60), (2, " ".join(f"g{n}" for n in range(70)))], "doc_id long, text string")
    model = QualityModel(np.zeros(1 << 14, dtype=np.float32), -5.0)
    assert [r["kept"] for r in score_quality(docs, model).collect()] == [False, False]
    assert [r["kept"] for r in score_quality(docs, model, keep_at=0.001).orderBy("doc_id").collect()] == [False, True]

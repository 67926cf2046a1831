import math
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusloom.llm.toxicity import HOMOGLYPHS, SUBSTITUTIONS, ToxicityModel, fit_toxicity, folded_words, score_toxicity, toxic_load
from corpusloom.session import is_train

DATA = "/root/testdata/sf0.1"


def test_folding():
    plain = folded_words("You IDIOT, moron")
    assert folded_words("you 1d10t m0r0n") == plain
    assert folded_words("yоu idiоt; ｍｏｒｏｎ") == plain  # Cyrillic and full-width letters
    assert folded_words("you id​iot moron") == plain
    assert folded_words(None) == folded_words("") == []


def test_exceptions_and_length():
    word = folded_words("trash")[0]
    model = ToxicityModel(((word, 4.0),), ("trash can",), -3.0)
    assert toxic_load(model, "put it in the trash can")[1] == 0
    assert toxic_load(model, "what trash, can you see")[1] == 0  # the phrase, whatever stands between its words
    assert toxic_load(model, "trash this trash can")[1] == 1
    assert toxic_load(model, "trash")[0] > toxic_load(model, "trash " + "fine " * 5_000)[0] > 0


@pytest.fixture(scope="module")
def fitted(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    return docs, labels, fit_toxicity(docs, labels.where(is_train("doc_id", 5)))


def test_held_out_accuracy(fitted):
    docs, labels, model = fitted
    held = score_toxicity(docs.join(labels, "doc_id").where(~is_train("doc_id", 5)), model).collect()
    assert {zlib.crc32(str(r["doc_id"]).encode()) % 5 for r in held} == {0}
    clean = [r["score"] >= 0.5 for r in held if not r["toxic"]]
    assert sum(clean) <= 0.005 * len(clean)
    for lang in ("en", "fr", "de", "es"):
        toxic = [r["score"] >= 0.5 for r in held if r["toxic"] and r["lang"] == lang]
        assert sum(toxic) >= (0.85 if len(toxic) > 10 else 0.5) * len(toxic), lang
    assert all(0 <= r["score"] <= 1 for r in held)


def skeleton(text):
    """Folding by a plain character loop."""
    out = []
    for c in (text or "").lower():
        if c in "\xad\u200b\u200c\u200d\u2060\ufeff":
            continue
        if "\uff01" <= c <= "\uff5e":
            c = chr(ord(c) - 0xFEE0).lower()
        c = HOMOGLYPHS.get(c, c)
        c = SUBSTITUTIONS.get(c, c)
        out.append(c if c.isascii() and c.isalnum() or ord(c) > 127 else " ")
    return "".join(out).split()


def test_load_and_score_against_brute_force(fitted):
    docs, labels, model = fitted
    rows = score_toxicity(docs.join(labels, "doc_id").where("doc_id % 7 = 0"), model).collect()
    assert len(rows) > 300
    spared = [skeleton(x) for x in model.exceptions]
    for r in rows:
        words = skeleton(r["text"])
        free = [not any(words[i - k : i - k + len(p)] == p for p in spared for k in range(len(p)) if i >= k) for i in range(len(words))]
        load, n = 0.0, 0
        for entry, weight in model.weights:
            name = entry.rstrip(b"*").decode(errors="surrogateescape")
            of = lambda w, i: (w.encode().startswith(name.encode(errors="surrogateescape")) if entry.endswith(b"*") else w == name) and free[i]  # noqa: B023, E731
            places = sum(of(w, i) for i, w in enumerate(words))
            n += places
            load += weight if places else 0.0
        want = 1 / (1 + math.exp(-(model.intercept + load / (1 + math.log1p(len(words))))))
        assert r["n_hits"] == n and abs(r["score"] - want) < 1e-9, r["doc_id"]


def test_copies_are_learned_from_once(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    common = [word() for _ in range(50)]
    rows = [(k, " ".join(rng.choices(common, k=20)) + (" verybadword" if k % 10 == 0 else ""), int(k % 10 == 0)) for k in range(400)]
    rows += [(1_000 + k, " ".join(common[:15]), 1) for k in range(300)]  # one mislabelled text, many times
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = fit_toxicity(df.drop("toxic"), df.select("doc_id", "toxic"))
    assert {e.rstrip(b"*") for e, w in model.weights if w > 0.5} <= {b"verybadw0rd".replace(b"0", b"o"), b"veryb", b"veryba", b"verybad"}


def test_lexicon_counts_against_brute_force(fitted):
    docs, labels, model = fitted
    texts = {}
    for r in docs.join(labels.where(is_train("doc_id", 5)), "doc_id").collect():
        texts[r["text"] or ""] = max(texts.get(r["text"] or "", 0), r["toxic"])
    seen = {0: Counter(), 1: Counter()}
    for text, label in texts.items():
        words = {w.encode() for w in skeleton(text)}
        seen[label].update(words | {w[:n] + b"*" for w in words for n in (5, 7) if len(w) > n})
    n1, n0, v = sum(texts.values()), len(texts) - sum(texts.values()), len({*seen[0], *seen[1]}) + 1
    share, want = n1 / (n0 + n1), set()
    for entry, t in seen[1].items():
        c = seen[0][entry]
        p = t / (t + c)
        ratio = 2 * (t * math.log(p / share) + (c * math.log((1 - p) / (1 - share)) if c else 0))
        if len(entry) > 1 and t >= 3 and p > share and ratio >= 2 * math.log(10 * v) and math.log(((t + 0.5) / (n1 + 1)) / ((c + 0.5) / (n0 + 1))) >= 1:
            want.add(entry)
    assert {e for e, _ in model.weights} == want


def test_edges(spark, fitted):
    _, _, model = fitted
    df = spark.createDataFrame([(None, 3, "t"), ("", None, "t"), ("idiot scum moron", 3, None), ("x " * 200_000, 3, "t")], "text string, SCORE_ int, _toxicity string")
    got = score_toxicity(df, model).collect()
    assert "score" in score_toxicity(df.withColumn("score", F.lit("old")), model).columns
    assert [r["_toxicity"] for r in got] == ["t", "t", None, "t"] and [r["score"] >= 0.5 for r in got] == [False, False, True, False]
    assert score_toxicity(df.limit(0), model).count() == 0


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, "c")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert fit_toxicity(docs, none).weights == ()
    one_class = spark.createDataFrame([(1, 1), (1, None), (None, 1)], "doc_id long, toxic int")
    scores = score_toxicity(docs, fit_toxicity(docs, one_class)).select(F.max("score")).first()[0]
    assert scores < 0.5

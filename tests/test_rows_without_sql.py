"""Queries that SQL cannot say, row by row against plain Python."""

from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from corpusloom.functions.text import phonetic
from corpusloom.operators.search import sound_alikes

SF = "/root/testdata/sf0.001"


def read(name):
    return pd.read_parquet(f"{SF}/{name}.parquet")


@pytest.fixture(scope="module")
def run(spark):
    return lambda name: entry.queries()[name](spark, SF).collect()


def events_in_order(by):
    e = read("events").sort_values(["ts", "event_id"])
    e["s"] = e["ts"].astype("datetime64[us]").astype("int64") / 1e6
    return {k: list(g.itertuples(index=False)) for k, g in e.groupby(by(e))}


def plain_chunks(text, size, overlap, most=80):
    out, at, step = [], 0, size - overlap
    while text and (at == 0 or at + overlap < len(text)):
        raw = text[at : at + size]
        if raw.strip(" \t\r\n"):
            out.append(raw.strip(" \t\r\n"))
        at += step
    return out[:most]


def test_phonetic_match(run):
    codes = defaultdict(list)
    rows = {r["word"]: r["code"] for r in run("phonetic_code")}
    for word, code in rows.items():
        assert code == phonetic(word)
        codes[code].append(word)
    want = {}
    for word, code in rows.items():
        others = [w for w in codes[code] if w != word]
        if others:
            want[word] = min(others, key=lambda w: (abs(len(w) - len(word)), w))
    assert {r["word"]: r["other"] for r in run("phonetic_match")} == want


def test_each_distinct_word_is_coded_once(spark):
    calls = spark.sparkContext.accumulator(0)

    @F.pandas_udf("string")
    def code(words: pd.Series) -> pd.Series:
        calls.add(len(words))
        return words.map(phonetic)

    names = spark.range(3_000).select(F.element_at(F.array(*map(F.lit, ("robert", "rupert", "tymczak"))), (F.col("id") % 3 + 1).cast("int")).alias("word")).distinct()
    got = {tuple(r) for r in sound_alikes(names.select("word", code("word").alias("code"))).collect()}
    assert got == {("robert", "rupert"), ("rupert", "robert")} and calls.value == 3


def test_chunk_analysis(run):
    texts = read("documents").set_index("doc_id")["text"]
    got = {r["id"]: r["text"] for r in run("chunk_analysis")}
    want = {i: "\n\n---\n\n".join(plain_chunks(t, 4_000, 200))[:16_000] for i, t in texts.items() if t and t.strip()}
    assert got == want


def test_chunk_mean_pool(spark, run):
    from corpusloom.functions.documents import hashing_embedder

    texts = read("documents").set_index("doc_id")["text"]
    rows = [(int(i), c) for i, t in texts.items() if t for c in plain_chunks(t, 700, 84, 5)]
    vectors = defaultdict(list)
    for r in spark.createDataFrame(rows, "id long, chunk string").select("id", hashing_embedder()("chunk").alias("v")).collect():
        vectors[r["id"]].append(r["v"])
    got = {r["id"]: r["embedding"] for r in run("chunk_mean_pool")}
    assert got.keys() == vectors.keys()
    assert all(np.allclose(v, np.mean(vectors[i], axis=0), atol=1e-6) for i, v in got.items())


def test_approx_count_distinct(run):
    exact = read("lineitem")["l_partkey"].nunique()
    assert abs(run("approx_count_distinct")[0]["parts"] - exact) <= 0.15 * exact


def test_dedupe_window(run):
    want = set()
    for user, rows in events_in_order(lambda e: e["user_id"]).items():
        last = None
        for r in rows:
            if last is None or r.s - last >= 3600:
                last = r.s
                want.add((user, r.event_id))
    assert {(r["user_id"], r["event_id"]) for r in run("dedupe_window")} == want


def test_undo_log(run):
    want = set()
    for user, rows in events_in_order(lambda e: e["user_id"]).items():
        done, undone = [], []
        for r in sorted(rows, key=lambda r: r.event_id):
            if r.event_type == "error":
                undone += [done.pop()] if done else []
            elif r.event_type == "view":
                done += [undone.pop()] if undone else []
            else:
                done, undone = [*done, r.event_id][-50:], []
        want |= {(user, x, True) for x in done} | {(user, x, False) for x in undone}
    assert {(r["session"], r["seq"], r["done"]) for r in run("undo_log")} == want


def test_circuit_state(run):
    want = {}
    for user, rows in events_in_order(lambda e: e["user_id"]).items():
        state, bad, good, since, last, opened = "CLOSED", 0, 0, 0.0, None, 0
        for r in rows:
            if state == "OPEN":
                if r.s - since < 7200:
                    continue
                state, good = "HALF", 0
            if state == "CLOSED" and last is not None and r.s - last >= 60:
                bad = 0
            last = r.s
            if r.event_type == "error":
                bad += 1
                if state == "HALF" or bad >= 2:
                    state, since, opened, bad = "OPEN", r.s, opened + 1, 0
            elif state == "HALF":
                good += 1
                if good >= 2:
                    state, bad = "CLOSED", 0
            else:
                bad = 0
        want[user] = ({"HALF": "HALF_OPEN"}.get(state, state), opened)
    assert {r["user_id"]: (r["state"], r["opened"]) for r in run("circuit_state")} == want


def test_pattern_learning(run):
    e = events_in_order(lambda e: e["event_type"] + ":" + (e["user_id"] % 20).astype(str))
    want = {}
    for key, rows in e.items():
        if key.split(":")[0] not in ("click", "error"):
            continue
        count, conf = 0, None
        for r in rows:
            if r.event_id % 3 != 0:
                count, conf = count + 1, 0.5 if conf is None else min(1.0, conf + 0.1)
            elif conf is not None:
                conf -= 0.15
                if conf < 0.1:
                    count, conf = 0, None
        want[key] = (count, round(conf or 0.0, 4), conf is not None)
    assert {r["key"]: (r["count"], r["confidence"], r["alive"]) for r in run("pattern_learning")} == want


def test_degradation_alerts(run):
    want = set()
    for pipeline, rows in events_in_order(lambda e: (e["user_id"] % 3).astype(str)).items():
        recent, last = [], None
        for r in rows:
            recent = [*recent, r.event_type][-200:]
            bad = len(recent) >= 20 and (recent.count("view") >= 0.5 * len(recent) or recent.count("error") >= 0.2 * len(recent))
            if bad and (last is None or r.s - last >= 86_400):
                last = r.s
                want.add((pipeline, r.event_id))
    assert {(r["pipeline"], r["id"]) for r in run("degradation_alerts")} == want


def test_capped_edges(run):
    e = read("embeddings")
    v = np.array(e["embedding"].to_list(), dtype=float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    s = v @ v.T
    ids = e["vec_id"].to_numpy()
    pairs = sorted((int(min(ids[i], ids[j])), int(max(ids[i], ids[j]))) for i in range(len(v)) for j in range(i) if s[i, j] >= 0.3)
    degree, want = defaultdict(int), set()
    for a, b in pairs:
        if degree[a] < 3 and degree[b] < 3:
            degree[a] += 1
            degree[b] += 1
            want.add((a, b))
    assert {(r["a"], r["b"]) for r in run("similarity_edges_capped")} == want

"""Histories of one key in many stretches, capped neighbours, repaired clusters and folder points against plain loops."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import graph as G
from corpusloom.operators import history as H
from corpusloom.operators import ordered as O
from corpusloom.operators import recommend as R
from corpusloom.operators import vectors as V
from corpusloom.streaming import events as E

OUTCOMES = "pipeline string, id long, s double, outcome string"


def history(n, seed=1):
    rng, s, out = random.Random(seed), 0.0, []
    for k in range(n):
        s += rng.choice([0.0, 0.5, 1.0])
        out.append(("hot" if rng.random() < 0.95 else rng.choice(["a", None]), k, s, rng.choice(["primary", "fallback", "error", None])))
    return out


def test_rolling_counts_of_one_hot_key(spark):
    rows = history(900)
    df = spark.createDataFrame(rows, OUTCOMES).repartition(5)
    got = {r["id"]: (r["n"], r["fallbacks"], r["errors"]) for r in H.degradation(df, window=20, stretch=100).collect()}
    for key in ("hot", "a", None):
        own = [r for r in rows if r[0] == key]
        for k, r in enumerate(own):
            last = own[max(0, k - 19) : k + 1]
            assert got[r[1]] == (len(last), sum(x[3] == "fallback" for x in last), sum(x[3] not in ("primary", "fallback") for x in last))
    assert len(got) == len(rows)
    numbered = O.numbered_in_keys(df, "pipeline", ["s", "id"], parts=7)
    assert sorted(r["nth"] for r in numbered.where("pipeline = 'hot'").collect()) == list(range(sum(r[0] == "hot" for r in rows)))


def test_a_hot_key_is_many_window_partitions(spark):
    df = spark.range(4_000).select(F.lit("one").alias("pipeline"), "id", F.col("id").cast("double").alias("s"), F.lit("primary").alias("outcome"))
    seen = O.over_last_rows(df, "pipeline", ["s", "id"], 199, lambda w: {"n": F.count("*").over(w), "_w": F.count("*").over(w)}, stretch=800)
    plan = seen._jdf.queryExecution().executedPlan().toString()
    assert "_stretch" in plan and seen.where("n < 200").count() == 199 and seen.count() == 4_000


@pytest.mark.parametrize("back", [1.0, 2.5])
def test_rate_limit_of_one_hot_key(spark, back):
    rows = history(600, 3)
    df = spark.createDataFrame([(r[0], r[1], r[2]) for r in rows] + [("hot", 9_000, None)], "key string, id long, s double")
    got = {r["id"]: (r["n"], r["allowed"]) for r in H.rate_limited(df, 4, back).collect()}
    for key, i, s, _ in rows:
        n = sum(r[0] == key and s - back <= r[2] <= s for r in rows)
        assert got[i] == (n, n <= 4)
    assert got[9_000][0] == 1


def test_own_changes_in_one_window(spark):
    rng = random.Random(5)
    ops = [(rng.choice(["/a", "/b", None]), round(rng.uniform(0, 60), 1)) for _ in range(30)] + [("/a", None)]
    events = [(n, rng.choice(["/a", "/b", "/c", None]), round(rng.uniform(0, 70), 1)) for n in range(300)] + [(900, "/a", None)]
    got = {r["id"] for r in E.not_our_own(spark.createDataFrame(events, "id long, path string, s double"), spark.createDataFrame(ops, "path string, s double"), 1.5).collect()}
    ours = {i for i, p, s in events if s is not None and any(p is not None and p == q and t is not None and t <= s < t + 1.5 for q, t in ops)}
    assert got == {i for i, _, _ in events} - ours and ours


def test_neighbours_with_caps(spark):
    rng = random.Random(7)
    edges = list({(rng.randrange(30), rng.randrange(30), rng.randrange(1, 6)) for _ in range(200)})
    seeds = [1, 2, 3]
    df, s = spark.createDataFrame(edges, "a long, b long, weight long"), spark.createDataFrame([(x,) for x in [*seeds, 3]], "node long")
    for most, new, least in ((1_000, 5, 1), (12, 6, 2), (10, 0, 1), (0, 5, 1)):
        near, want = set(), []
        for a, b, w in sorted((e for e in edges if e[2] >= least and (e[0] in seeds or e[1] in seeds)), key=lambda e: (-e[2], e[0], e[1])):
            if len(want) >= most:
                break
            other = b if a in seeds else a
            if other not in seeds and other not in near:
                if len(near) >= new:
                    continue
                near.add(other)
            want.append((a, b, w, None if other in seeds else other))
        assert sorted(map(repr, map(tuple, G.neighbour_edges(df, s, min_weight=least, max_edges=most, max_neighbours=new).collect()))) == sorted(map(repr, want))


def plain_lloyd(v, centres, rounds=50):
    centres = centres.copy()
    for _ in range(rounds):
        d = ((v[:, None] - centres[None]) ** 2).sum(2)
        at, far = d.argmin(1), d.min(1)
        new = centres.copy()
        order = iter(sorted(range(len(v)), key=lambda i: (-far[i], i)))
        for c in range(len(centres)):
            new[c] = v[at == c].mean(0) if (at == c).any() else v[next(order)]
        if np.allclose(new, centres, atol=1e-9):
            break
        centres = new
    return centres


def test_empty_clusters_get_the_farthest_rows(spark):
    rng = np.random.default_rng(3)
    v = np.concatenate([rng.normal(m, 0.1, (40, 2)) for m in ((0, 0), (5, 5), (9, 0), (0, 9))])
    start = np.array([[0.0, 0.0], [100.0, 100.0], [100.0, 101.0], [101.0, 100.0], [5.0, 5.0]])  # three of these are nobody's nearest
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>").repartition(3).checkpoint()
    got = V.lloyd(rows, start)
    assert np.allclose(got, plain_lloyd(v, start))
    assert np.abs(got).max() < 20


def test_more_folders_than_a_matrix_holds(spark):
    rng = np.random.default_rng(1)
    files = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.normal(size=(40, 4)))], "vec_id long, embedding array<double>")
    folders = spark.createDataFrame([(100 + i, x.tolist()) for i, x in enumerate(rng.normal(size=(15, 4)))], "folder long, embedding array<double>")
    three = lambda df: sorted((r["vec_id"], r["folder"], round(r["score"], 9)) for r in df.collect())
    for k in (1, 3, None):
        assert three(V.best_folders(files, folders, k)) == three(V.best_folders(files, folders, k, max_queries=6))


def test_bridges_take_the_nearest_members(spark):
    files = spark.createDataFrame([(n, [1.0, n / 10], 0) for n in range(6)] + [(10 + n, [n / 10, 1.0], 1) for n in range(6)], "vec_id long, embedding array<double>, label int")
    centres = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "folder long, embedding array<double>")
    got = {(r["label"], r["other"], r["vec_id"]) for r in V.bridges(files, centres, threshold=0.3, least=0.1, members=4, most=2).collect()}
    assert got == {(0, 1, 3), (0, 1, 2), (1, 0, 13), (1, 0, 12)}
    assert not V.bridges(files, centres, threshold=0.7, members=4).collect()


def test_folder_points(spark):
    files = spark.createDataFrame([(1, "Invoice_2024 ACME.PDF"), (2, "part.stl"), (3, "x"), (4, None), (5, "ab.txt")], "file long, name string")
    folders = spark.createDataFrame(
        [("Invoices", "bills, pdf and such", ["invoice"], ["acme"], "/home/acme/bills", "money", ["Invoice"], 0.9), ("Acme Invoice", None, None, None, None, None, None, None), ("Prints", "models .stl", ["stl"], [".stl"], None, None, None, 0.5), ("b", "", ["", None], [], "", "", [], None)],
        "folder string, description string, tags array<string>, keywords array<string>, path string, category string, related array<string>, confidence double",
    )
    got = {(r["file"], r["folder"]): r["score"] for r in R.score_folders(files, folders, all_scores=True).collect()}
    invoices = (5 + 4 + 3 + 1 + 15) * 1.2  # tag, keyword, path, related, extension in the description
    assert got == pytest.approx({(1, "Invoices"): invoices, (1, "Acme Invoice"): 16.0, (2, "Prints"): 15 + 5 + 10 + 4 + 12, (5, "b"): 10})
    assert {(r["file"], r["folder"]) for r in R.score_folders(files, folders).collect()} == {(1, "Invoices"), (2, "Prints"), (5, "b")}
    assert R.score_folders(files, folders.limit(0)).count() == 0 and R.score_folders(files.limit(0), folders.select("folder")).count() == 0


def test_containing_finds_substrings(spark):
    texts, terms = ["banana", "an", "", None, "nab"], ["an", "ana", "banana!", "b", "", "nana"]
    a = spark.createDataFrame(list(enumerate(texts)), "text_id long, text string")
    b = spark.createDataFrame(list(enumerate(terms)), "term_id long, term string")
    got = {(r["text_id"], r["term_id"]) for r in R.containing(a, b).collect()}
    assert got == {(i, j) for i, t in enumerate(texts) for j, w in enumerate(terms) if t is not None and w and w in t}


def test_head_batches(spark):
    kinds = ["i"] * 5 + ["d"] + [None, None] + ["d"] * 3 + ["i"]
    df = spark.createDataFrame([("q", n, k) for n, k in enumerate(kinds)], "queue string, n long, k string")
    got = [r["batch"] for r in O.head_batches(df, F.col("k"), {"i": 3, "d": 2}, ["n"]).orderBy("n").collect()]
    assert got == [1, 1, 1, 2, 2, 3, 4, 5, 6, 6, 7, 8]


def test_appended_places(spark):
    stored = spark.createDataFrame([(1, 4), (1, 9), (2, None)], "c long, sort_order long")
    new = spark.createDataFrame([(1, "b"), (1, "a"), (2, "x"), (3, "y")], "c long, t string")
    assert {tuple(r) for r in O.append_in_order(stored, new, "c", ["t"]).select("c", "t", "sort_order").collect()} == {(1, "a", 10), (1, "b", 11), (2, "x", 1), (3, "y", 1)}


def test_refused_rows_are_kept(spark):
    items = spark.createDataFrame([(n, n, f"2024-01-01 00:00:0{n}") for n in range(6)], "key long, id long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    kept, refused = [], []
    told = E.flush_queue(items, lambda df: kept.extend(r["id"] for r in df.collect()), refuse=lambda df: refused.extend(r["id"] for r in df.collect()), size=2, capacity=4)
    assert sorted(kept) == [0, 1, 2, 3] and sorted(refused) == [4, 5] and told["refused"] == 2


def test_phrases_are_quoted_and_temporary_names_known(spark):
    df = spark.createDataFrame([("c vs d",), ("is c++ fast",), ("abc++",), ("what (if)",)], "t string")
    assert [r[0] for r in df.select(T.any_phrase(F.col("t"), ("c++",), 100)).collect()] == [False, True, False, False]
    assert [r[0] for r in df.select(T.any_phrase(F.col("t"), ("(if)", "vs"), 100)).collect()] == [True, False, False, True]
    names = ["/a/x.tmp", "/a/x.BAK", "b.crdownload", "/a/~$doc.docx", "/a/.#lock", "/a/#auto#", "x~", "/a/.DS_Store", "C:\\d\\Thumbs.db", "y.!qB", "/a/._r", "/tmp/x.txt", "/a.part/b", "lock", "desktop.ini.txt"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "p string").select(T.temporary_file(F.col("p"))).collect()]
    assert got == [True] * 11 + [False] * 4
    assert math.isclose(sum(got), 11)


def test_moves_of_one_size_without_pairs(spark):
    rng = random.Random(9)
    file = lambda k: (k, f"/{rng.choice('ab')}/{rng.choice(['x.TXT', 'y.txt', 'z.pdf'])}", rng.choice([5, 5, 5, 6, None]), rng.choice([round(rng.uniform(0, 200), 1), None] if k % 25 == 0 else [round(rng.uniform(0, 200), 1)]))
    gone, new = [file(k) for k in range(120)], [file(1_000 + k) for k in range(150)]
    base = lambda p: p.rsplit("/", 1)[1].lower()
    want = set()
    for i, p, size, s in new:
        near = [g for g in gone if size is not None and s is not None and g[2] == size and g[3] is not None and base(g[1])[1:] == base(p)[1:] and abs(round(g[3] * 10) - round(s * 10)) <= 20]
        named = [g for g in near if base(g[1]) == base(p)]
        if len(near) == 1 or len(named) == 1:
            want.add((near[0][0] if len(near) == 1 else named[0][0], i))
    frame = lambda rows: spark.createDataFrame(rows, "id long, path string, size long, s double").repartition(3)
    got = R.moves(frame(gone), frame(new), tolerance_s=2.0).collect()
    assert {(r["deleted"], r["added"]) for r in got} == want and len(got) == len(want) > 10

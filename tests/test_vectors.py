import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import vectors as V


def frame(spark, n=400, dim=8, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(n, dim)))]
    rows[5] = (5, rows[4][1])  # a tie
    odd = [(1_000, None), (1_001, []), (1_002, [1.0] * (dim - 1)), (1_003, [float("nan")] * dim), (1_004, [0.0] * dim), (1_005, [None] * dim), (1_006, [float("inf")] + [0.0] * (dim - 1))]
    return spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>"), dict(rows)


def brute(vectors, asked, k, where=lambda i: True):
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in vectors.items()}
    out = {}
    for q in asked:
        best = sorted(((-round(float(unit[q] @ u), 12), i) for i, u in unit.items() if where(i)))[:k]
        out[q] = [i for _, i in best]
    return out


@pytest.mark.parametrize("most", [10_000, 3])  # sent to all tasks, or dealt to parts of the items
def test_top_k_against_brute_force(spark, most, monkeypatch):
    monkeypatch.setattr(V, "PART_ROWS", 90)
    monkeypatch.setattr(V, "TILE", 7)
    df, vectors = frame(spark)
    queries = df.where("vec_id % 20 = 0 OR vec_id >= 1000").select(F.col("vec_id").alias("query"), "embedding")
    for where, of in ((None, lambda i: True), (F.col("vec_id") % 2 == 1, lambda i: i % 2 == 1)):
        got = {}
        for r in V.top_k(df, queries, 6, where=where, max_queries=most).orderBy("query", "rank").collect():
            got.setdefault(r["query"], []).append(r["vec_id"])
        assert got == brute(vectors, range(0, 400, 20), 6, of)
    assert V.scores(df, queries, None, max_queries=most).count() == 20 * 400
    near = V.scores(df, queries, None, min_score=0.5, max_queries=most).collect()
    assert near and all(r["score"] >= 0.5 for r in near)
    assert V.top_k(df.limit(0), queries, 3, max_queries=most).count() == V.top_k(df, queries.limit(0), 3, max_queries=most).count() == 0


def test_search_by_chunks_and_folders(spark):
    df, vectors = frame(spark)
    queries = df.where("vec_id % 100 = 0 AND vec_id < 1000").select(F.col("vec_id").alias("query"), "embedding")
    got = V.chunk_search(df, queries, files=4, chunks_each=12, file=F.floor(F.col("vec_id") / 4)).orderBy("query", "rank").collect()
    for q, best in brute(vectors, range(0, 400, 100), 12).items():
        files = list(dict.fromkeys(i // 4 for i in best))[:4]
        assert [(r["file"], r["chunk"]) for r in got if r["query"] == q] == [(f, next(i for i in best if i // 4 == f)) for f in files]
    folders = df.where("vec_id < 30").select(F.col("vec_id").alias("folder"), "embedding", F.when(F.col("vec_id") % 2 == 0, '{"n": 1}').otherwise("[").alias("meta"))
    hits = V.folder_search(folders, queries, 3, schema="n int").collect()
    assert len(hits) == 12 and {(r["folder"] % 2, r["meta"] and r["meta"]["n"]) for r in hits} <= {(0, 1), (1, None)}


def test_pairs_means_and_clusters_leave_odd_vectors_out(spark):
    df, vectors = frame(spark, 60)
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in vectors.items()}
    want = {(a, b) for a in unit for b in unit if a < b and unit[a] @ unit[b] >= 0.6}
    assert {(r["a"], r["b"]) for r in V.similar_pairs(df, 0.6, tile=16).collect()} == want
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=4) * 0.1 + 10 * np.eye(4)[i % 4]]) for i in range(200)]
    four = spark.createDataFrame(rows + [(999, None)], "vec_id long, embedding array<double>")
    found = {r["vec_id"]: r["cluster"] for r in V.kmeans(four, 4).collect()}
    assert len(found) == 200 and len({(i % 4, c) for i, c in found.items()}) == 4
    assert V.kmeans(four.limit(0), 4).count() == 0
    with pytest.raises(ValueError):
        V.best_of_few(four, [(i, [0.0]) for i in range(V.MAX_QUERIES + 1)], 1)


def test_bridges_look_at_all_members(spark):
    """Sixty members lie at one centre and one, far out, lies next to the other centre: it is the bridge."""
    rows = [(i, 0, [1.0, 0.001 * i]) for i in range(60)] + [(60, 0, [0.2, 1.0])] + [(100 + i, 1, [0.0, 1.0]) for i in range(3)]
    files = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    centres = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "folder long, embedding array<double>")
    found = [{r["vec_id"] for r in V.bridges(files, centres, threshold=0.3, least=0.1, **some).collect() if r["label"] == 0} for some in ({"members": None}, {})]
    assert found == [{60}, set()]


def test_bridge_files_ranks_every_member(spark):
    from corpusloom.plans import vectors as plans

    spec = plans.bridge_files(spark, "/root/testdata/sf0.1")
    e = plans.vectors(spark, "/root/testdata/sf0.1").toPandas()
    v = np.stack(e["embedding"].to_list()).astype(float)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    labels = e["label"].to_numpy()
    want = set()
    for other in set(labels):
        c = v[labels == other].mean(axis=0)
        score = (unit @ (c / np.linalg.norm(c))).round(2)
        for label in set(labels) - {other}:
            best = sorted((-s, i) for s, i in zip(score[labels == label], e["vec_id"][labels == label], strict=True))[:3]
            want |= {(label, other, i) for s, i in best if -s >= 0.1}
    assert {(r["label"], r["other"], r["vec_id"]) for r in spec.collect()} == want


def test_products_stay_small_whatever_the_batch(monkeypatch):
    """A whole batch against all queries is never one matrix, and blocks give the same k best."""
    import tracemalloc

    rng = np.random.default_rng(2)
    v, matrix = rng.normal(size=(10_000, 8)), rng.normal(size=(1_500, 8))
    tracemalloc.start()
    found = V.Running(np.arange(1_500), 5)
    for part in V._best(np.arange(1_500), matrix, np.arange(10_000), v, 5, None, found.edge):
        found.add(part)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64e6
    kept = found.cut()
    s = matrix @ v.T
    assert kept["id"].to_numpy().reshape(1_500, 5).tolist() == np.argsort(-s, axis=1)[:, :5].tolist()


def test_dealt_queries_send_on_k_rows_a_query(spark, monkeypatch):
    monkeypatch.setattr(V, "ITEMS", 16)
    df, _ = frame(spark)
    queries = df.where("vec_id % 20 = 0 AND vec_id < 1000").select(F.col("vec_id").alias("query"), "embedding")
    assert V.scores(df, queries, 3, max_queries=3).count() == 20 * 3


def test_dealt_queries_pass_by_in_slices(spark, monkeypatch):
    monkeypatch.setattr(V, "PART_ROWS", 200)
    monkeypatch.setattr(V, "PASSING", 50)
    df, vectors = frame(spark)
    queries = df.where("vec_id < 400").select(F.col("vec_id").alias("query"), "embedding")
    found = V.scores(df, queries, 6, max_queries=3)
    assert found.rdd.getNumPartitions() == 2 * 8  # each a part of items and a slice of queries
    got = {}
    for r in V.top_k(df, queries, 6, max_queries=3).orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append(r["vec_id"])
    assert got == brute(vectors, range(400), 6)

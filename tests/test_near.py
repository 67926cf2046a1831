"""The pruned self-join against all pairs."""

import numpy as np
import pytest

from corpusloom.operators.graph import capped_edges, capped_pairs, pair_groups
from corpusloom.operators.near import JoinReport, near_pairs, similar_groups, similar_pairs
from corpusloom.session import table


def clustered(n, size, groups, spread, seed=1):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(groups, size))
    return middle[rng.integers(groups, size=n)] + spread * rng.normal(size=(n, size))


def frame(spark, v):
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<double>").repartition(4)


def brute(v, threshold):
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = u @ u.T
    return {(int(a), int(b)): round(s[a, b], 9) for a, b in zip(*np.nonzero(np.triu(s >= threshold - 1e-12, 1)))}  # noqa: B905


def rows(df):
    got = df.collect()
    out = {(r["a"], r["b"]): round(r["score"], 9) for r in got}
    assert len(out) == len(got)  # a pair comes once
    return out


@pytest.mark.parametrize(("threshold", "residents"), [(0.9, 40), (0.5, 40), (0.5, 1_000), (-0.2, 60)])
def test_no_link_is_lost(spark, threshold, residents):
    v = np.concatenate([clustered(300, 6, 9, 0.2), clustered(200, 6, 1, 0.05, 3), np.full((25, 6), 0.3), clustered(300, 6, 9, 0.2)[:8]])
    report = JoinReport.of(spark)
    got = rows(similar_pairs(frame(spark, v), threshold, residents=residents, report=report))
    assert got.keys() == brute(v, threshold).keys()
    assert got == pytest.approx(brute(v, threshold), abs=1e-8)
    assert report.vectors == 500 + 1 and report.slices >= report.cells


@pytest.mark.parametrize("threshold", [0.5, 0.7, 0.9])
def test_clustered_vectors_are_compared_with_few(spark, threshold):
    v = clustered(3_000, 32, 40, 0.15)
    report = JoinReport.of(spark)
    got = rows(near_pairs(frame(spark, v).selectExpr("vec_id AS id", "embedding AS v").checkpoint(), threshold, residents=64, report=report))
    assert got.keys() == brute(v, threshold).keys()
    pairs = len(v) * len(v) / 2
    assert report.compared.value < 0.2 * pairs
    assert report.bounded.value < 0.6 * pairs


def test_the_tables_vectors(spark):
    e = table(spark, "/root/testdata/sf0.1", "embeddings")
    v = np.array([r["embedding"] for r in e.orderBy("vec_id").collect()], dtype=float)
    for threshold, most in ((0.5, 0.35), (0.7, 0.1), (0.9, 0.05)):
        report = JoinReport.of(spark)
        got = rows(similar_pairs(e, threshold, residents=256, report=report))
        assert got.keys() == brute(v, threshold).keys()
        assert report.compared.value < most * len(v) ** 2 / 2


def test_copies_stay_members(spark):
    v = np.concatenate([np.tile([[1.0, 0.0]], (500, 1)), [[0.99, 0.1], [0.0, 1.0]]])
    pairs, members = similar_groups(frame(spark, v), 0.9)
    assert set(rows(pairs)) == {(0, 500)}
    assert {r["id"] for r in members.collect()} == {0} and members.count() == 500


def test_odd_vectors_have_no_pairs(spark):
    odd = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [1.0]), (6, [1.0, 0.0]), (7, [1.0, 0.1]), (8, [2.0, None])]
    df = spark.createDataFrame(odd, "vec_id long, embedding array<double>")
    assert set(rows(similar_pairs(df, 0.9))) == {(6, 7)}
    assert similar_pairs(df.limit(0), 0.9).count() == 0
    assert similar_pairs(df.where("vec_id = 6"), 0.9).count() == 0


def test_what_a_task_deals_is_bounded(spark):
    """However many slices a vector visits, a batch is dealt in parts: no Arrow batch holds a whole batch's visits."""
    import corpusloom.operators.near as near

    assert near.PAIRS * 64 * 8 <= 16e6 and near.TILE * near.MOST_RESIDENTS * 8 <= 32e6 and near.DEALT * 64 * 8 <= 16e6
    v = clustered(600, 6, 3, 0.5)
    once = frame(spark, v).selectExpr("vec_id AS id", "embedding AS v").checkpoint()
    small = near.DEALT
    try:
        near.DEALT = 50
        assert rows(near_pairs(once, 0.8, residents=20)).keys() == brute(v, 0.8).keys()
    finally:
        near.DEALT = small


@pytest.mark.parametrize(("threshold", "most_open"), [(0.3, 1_000), (0.9, 30)])
def test_capped_pairs_are_those_of_all_pairs(spark, threshold, most_open):
    v = np.concatenate([clustered(400, 16, 9, 0.4), np.full((25, 16), 0.3), clustered(200, 16, 3, 2.0, 3)])
    df = frame(spark, v).unionByName(spark.createDataFrame([(None, [1.0] * 16), (9_000, None), (9_001, [0.0] * 16), (9_002, [1.0])], "vec_id long, embedding array<double>"))
    for some in (df, df.unionByName(df.where("vec_id % 50 = 0").selectExpr("vec_id + 1 AS vec_id", "embedding"))):  # the second repeats ids
        want = rows(capped_edges(similar_pairs(some, threshold)))
        assert rows(capped_pairs(some, threshold, rows=100, most_open=most_open)) == want and want


def test_capped_pairs_do_not_need_all_pairs(spark, monkeypatch):
    """Where vectors find partners soon, pairs are not made, and a task gets a block and the open vectors."""
    import corpusloom.operators.graph as graph

    v = np.random.default_rng(2).normal(size=(3_000, 16))
    assert capped_pairs(frame(spark, v).limit(0), 0.3).count() == 0
    monkeypatch.setattr(graph, "similar_pairs", None)
    assert len(rows(capped_pairs(frame(spark, v), 0.3, rows=500, most_open=300))) > 4_000


@pytest.mark.parametrize(("threshold", "residents"), [(0.9, 40), (0.5, None)])
def test_groups_of_pairs_without_the_pairs(spark, monkeypatch, threshold, residents):
    import corpusloom.operators.graph as graph

    v = np.concatenate([clustered(300, 16, 9, 0.3), np.full((25, 16), 0.3), clustered(300, 16, 9, 0.3)[:8], np.eye(16)[:1] - 9, np.eye(16)[:1] - 9])
    label, pairs = list(range(len(v))), brute(v, threshold)
    for a, b in [*pairs] * 8:
        label[a] = label[b] = min(label[a], label[b])
    want = {}
    for (a, _), s in pairs.items():
        assert label[a] == label[label[a]]
        want.setdefault(label[a], []).append(s)
    df = frame(spark, v).unionByName(spark.createDataFrame([(None, [0.3] * 16), (9_000, None), (9_001, [0.0] * 16)], "vec_id long, embedding array<double>"))
    again = pair_groups(df.unionByName(df.where("vec_id = 300")), threshold, residents=residents).collect()  # an id that repeats is no pair with itself
    monkeypatch.setattr(graph, "similar_pairs", None)
    got = pair_groups(df, threshold, residents=residents).collect()
    assert {r["component"]: (r["size"], r["mean"]) for r in got} == {k: (label.count(k), pytest.approx(np.mean(s), abs=0.00501)) for k, s in want.items()}
    assert {(r["component"], r["size"]) for r in again} == {(r["component"], r["size"]) for r in got}
    assert pair_groups(df.limit(0), threshold).count() == 0

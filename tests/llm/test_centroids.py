"""Kd-tree filtering against plain rounds over all vectors and centroids."""

import hashlib
import math

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from corpusloom.llm.centroids import build_tree, cluster_vectors, settle

SF = "/root/testdata/sf0.001"


def brute(rows, k=16, rounds=3, size=64):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    limit = math.isqrt(2**62 // size) // 4
    kept = [(i, [max(-limit, min(limit, x)) for x in v]) for i, v in kept]
    first = sorted((i is None, hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept)[:k]
    centres = [v for _, _, v in first]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))  # noqa: B905,E731
    nearest = lambda v: min(range(len(centres)), key=lambda c: (far(v, centres[c]), c))
    for _ in range(rounds):
        at = [nearest(v) for _, v in kept]
        new = []
        for c, old in enumerate(centres):
            own = [v for (_, v), a in zip(kept, at) if a == c]  # noqa: B905
            new.append([sum(x) // len(own) for x in zip(*own)] if own else old)  # noqa: B905
        centres = new
    out = [(i, c := nearest(v), far(v, centres[c])) for i, v in kept]
    total = sum(d for _, _, d in out)
    own = {c: sum(d for _, x, d in out if x == c) for _, c, _ in out}
    return [(i, c, d, own[c], total, hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()) for i, c, d in out]


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda x: tuple((v is None, v or 0) for v in x[:3]))


def sample(n, size, seed=5):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(12, size))
    v = middle[rng.integers(12, size=n)] + rng.normal(scale=0.2, size=(n, size))
    return [(int(i), [float(x) for x in r]) for i, r in enumerate(v)]


ODD = [
    (900, None), (901, []), (902, [1.0]), (903, [float("nan")] * 3), (904, [1.0, None, 2.0]), (905, [float("inf"), 0.0, 0.0]),
    (906, [1e30, -1e30, 0.5]), (None, [0.1, 0.2, 0.3]), (907, [-0.001, 0.0, 0.001]),
]


@pytest.mark.parametrize("k", [1, 4, 16, 400])
def test_equals_plain_rounds(spark, k):
    rows = sample(260, 3) + ODD + [(1_000 + n, [0.5, 0.25, 0.125]) for n in range(120)] + sample(10, 3)
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, id string, cluster int").repartition(3)
    got = cluster_vectors(df, k=k, size=3)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert ordered(got.collect()) == ordered(brute(rows, k=k, size=3))


def test_nothing_to_cluster(spark):
    df = spark.createDataFrame(ODD[:6], "vec_id long, embedding array<double>")
    assert cluster_vectors(df, size=3).collect() == []
    assert cluster_vectors(df.limit(0)).collect() == []


def test_tree_settles_as_all_pairs_do_and_prunes():
    rng = np.random.default_rng(3)
    for size in (1, 2, 64):
        points = rng.integers(-300, 300, (3_000, size)).astype(np.int32)
        points[1_000:1_600] = points[7]
        centres = np.concatenate([rng.integers(-300, 300, (12, size)), points[:2], points[:2]]).astype(np.int64)  # equal centroids: the smaller number
        order, tree = build_tree(points)
        assert sorted(order) == list(range(3_000))
        found = settle(tree, centres)
        all_pairs = ((tree.points[:, None].astype(np.int64) - centres[None]) ** 2).sum(2)
        assert (found.cluster == all_pairs.argmin(1)).all()
        assert (found.counts == np.bincount(all_pairs.argmin(1), minlength=16)).all()
        for c in range(16):
            assert (found.sums[c] == tree.points[found.cluster == c].sum(0, dtype=np.int64)).all()
        assert found.distances + 16 * found.nodes < (0.3 if size < 3 else 1.2) * all_pairs.size


def test_query_equals_its_sql(spark):
    got = entry.queries()["op12_centroids"](spark, SF)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = con.execute(entry.oracle_sql()["op12_centroids"]).fetchall()
    assert ordered(got.collect()) == ordered(want)
    assert want

"""Centroid clustering by kd-tree filtering, in exact integers.

Vectors become integers once. Each task cuts its rows into blocks and builds a kd-tree over
each: a node holds the box, the count and the integer sums of its vectors. The trees are
written to the shared folder, and every round passes the centroids down them. At a node, the
centroid nearest to the middle of the box is compared with the others: one that is strictly
farther from every place of the box is pruned for all that lies below. A node with one
centroid left is assigned as a whole, by its count and sums; vectors of a leaf are compared
with the centroids that are left. A round sends on k counts and sums a task.

Defined results: vectors of another length, with a null or with a component that is not
finite are left out, null vectors among them. Components beyond 2**26 after scaling are held
at that bound, so that all distances fit 64 bits. Repeated rows are vectors of their own.
Rows with a null id are clustered like others, but start no centroid while others are left.
With fewer vectors than centroids there are as many centroids as vectors; none give no rows.
Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.scan import bounded_batches
from corpusloom.operators.vectors import doubles, first_bad
from corpusloom.session import cut_lineage

BLOCK, LEAF = 4_096, 32  # vectors of a tree, and of a leaf at most (unless all are equal)
PRODUCT = 1 << 21  # cells of a step down at a time
_FARTHEST = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Tree:
    """Points in the order of the tree; a node's points stand at start to stop, its children at child and child + 1 (-1: a leaf)."""

    points: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    child: np.ndarray
    low: np.ndarray
    high: np.ndarray
    sums: np.ndarray


def build_tree(points: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, Tree]:
    """The order of the points, and the tree: nodes are cut at the median of the widest side."""
    order = np.arange(len(points))
    start, stop, child, low, high, sums = [0], [len(points)], [], [], [], []
    at = 0
    while at < len(start):
        a, b = start[at], stop[at]
        own = points[order[a:b]]
        low.append(own.min(0))
        high.append(own.max(0))
        sums.append(own.sum(0, dtype=np.int64))
        side = (high[-1].astype(np.int64) - low[-1]).argmax()
        if b - a <= leaf or high[-1][side] == low[-1][side]:
            child.append(-1)
        else:
            half = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(own[:, side], half)]
            child.append(len(start))
            start += [a, a + half]
            stop += [a + half, b]
        at += 1
    whole = [np.array(x, dtype=np.int32) for x in (start, stop, child)]
    return order, Tree(points[order], *whole, np.array(low), np.array(high), np.array(sums))


@dataclass
class Settled:
    """The cluster of each point of a tree, the clusters' counts and sums, and what that cost: nodes seen and distances of points."""

    cluster: np.ndarray
    counts: np.ndarray
    sums: np.ndarray
    nodes: int = 0
    distances: int = 0


def settle(tree: Tree, centres: np.ndarray) -> Settled:
    """Passes the centroids down the tree; the nearest one wins, of equals the smallest number."""
    k, d = centres.shape
    out = Settled(np.zeros(len(tree.points), dtype=np.int32), np.zeros(k, dtype=np.int64), np.zeros((k, d), dtype=np.int64))
    waiting = [(np.array([0]), np.ones((1, k), dtype=bool))]
    most = max(1, PRODUCT // (k * d))
    while waiting:
        at, alive = waiting.pop()
        if len(at) > most:
            waiting += [(at[most:], alive[most:])]
            at, alive = at[:most], alive[:most]
        out.nodes += len(at)
        low, high = tree.low[at].astype(np.int64), tree.high[at].astype(np.int64)
        middle = ((2 * centres[None] - (low + high)[:, None]) ** 2).sum(2)
        nearest = centres[np.where(alive, middle, _FARTHEST).argmin(1)]
        apart = centres[None] - nearest[:, None]
        corner = np.where(apart > 0, high[:, None], low[:, None])  # the place of the box that speaks most for a centroid
        alive = alive & ((apart * (centres[None] + nearest[:, None] - 2 * corner)).sum(2) <= 0)
        one = alive.sum(1) == 1
        for node, winner in zip(at[one], alive[one].argmax(1), strict=True):
            a, b = tree.start[node], tree.stop[node]
            out.cluster[a:b] = winner
            out.counts[winner] += b - a
            out.sums[winner] += tree.sums[node]
        for node, left in zip(at[~one & (tree.child[at] < 0)], alive[~one & (tree.child[at] < 0)], strict=True):
            a, b = tree.start[node], tree.stop[node]
            names = np.flatnonzero(left)
            own = tree.points[a:b].astype(np.int64)
            far = (centres[names] ** 2).sum(1)[None] - 2 * (own @ centres[names].T)  # the points' own squares are the same for all
            won = names[far.argmin(1)]
            out.distances += far.size
            out.cluster[a:b] = won
            out.counts += np.bincount(won, minlength=k)
            for name in np.unique(won):
                out.sums[name] += own[won == name].sum(0)
        down = ~one & (tree.child[at] >= 0)
        if down.any():
            below = tree.child[at[down]]
            waiting.append((np.concatenate([below, below + 1]), np.concatenate([alive[down], alive[down]])))
    return out


_TREE = "points binary, start array<int>, stop array<int>, child array<int>, low binary, high binary, sums binary"


def _integers(batch: pa.RecordBatch, size: int, scale: int) -> np.ndarray:
    limit = math.isqrt((1 << 62) // max(size, 1)) // 4
    v = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
    return np.clip(np.floor(scale * v), -limit, limit).astype(np.int32 if limit < 1 << 31 else np.int64)


def _trees(rows: pa.RecordBatch, size: int) -> Iterator[tuple[pa.Array, Tree]]:
    for ids, *rest in zip(*(rows.column(n) for n in ("ids", "points", "start", "stop", "child", "low", "high", "sums")), strict=True):
        points, start, stop, child, low, high, sums = rest
        small = lambda x: np.frombuffer(x.as_py(), dtype=np.int32).reshape(-1, size)
        listed = (np.array(x.as_py(), dtype=np.int32) for x in (start, stop, child))
        yield ids.values, Tree(small(points), *listed, small(low), small(high), np.frombuffer(sums.as_py(), dtype=np.int64).reshape(-1, size))


def tree_table(rows: DataFrame, size: int, scale: int) -> DataFrame:
    """(ids, tree): one row for each block of (id, v)."""
    id_type = rows.schema["id"].dataType.simpleString()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, points, held = [], [], 0
        for batch in batches:
            ids.append(batch.column("id"))
            points.append(_integers(batch, size, scale))
            held += len(batch)
            if held >= BLOCK:
                yield from blocks(ids, points)
                ids, points, held = [], [], 0
        if held:
            yield from blocks(ids, points)

    def blocks(ids: list[pa.Array], points: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        all_ids, all_points = pa.concat_arrays(ids), np.concatenate(points)
        for a in range(0, len(all_points), BLOCK):
            order, tree = build_tree(all_points[a : a + BLOCK])
            own = all_ids.slice(a, BLOCK).take(pa.array(order))
            lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (own, *(pa.array(y) for y in (tree.start, tree.stop, tree.child)))]
            raw = [pa.array([x.tobytes()], pa.binary()) for x in (tree.points, tree.low, tree.high, tree.sums)]
            yield pa.RecordBatch.from_arrays([lists[0], raw[0], *lists[1:], *raw[1:]], ["ids", "points", "start", "stop", "child", "low", "high", "sums"])

    return rows.mapInArrow(build, f"ids array<{id_type}>, {_TREE}")


def first_centres(rows: DataFrame, k: int, size: int, scale: int, prefix: str) -> np.ndarray:
    """The k vectors with the smallest hash of their id, in its order; equal hashes by vector."""
    by_hash = F.sha2(F.concat(F.lit(prefix), F.col("id").cast("string")), 256)
    few = rows.orderBy(F.asc_nulls_last(by_hash), "v").limit(k).select("id", "v").toArrow()
    return np.concatenate([np.zeros((0, size), dtype=np.int64), *(_integers(b, size, scale).astype(np.int64) for b in few.to_batches() if len(b))])


def cluster_vectors(vectors: DataFrame, *, k: int = 16, rounds: int = 3, size: int = 64, scale: int = 64, prefix: str = "1:", id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id_col, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that is kept."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    v = F.col(vec_col)
    rows = vectors.where((F.size(v) == size) & (first_bad(v) == 0)).select(F.col(id_col).alias("id"), doubles(v).alias("v"))
    centres = first_centres(rows, k, size, scale, prefix)
    id_type = rows.schema["id"].dataType.simpleString()
    trees = cut_lineage(tree_table(rows, size, scale))
    n, d = centres.shape
    for _ in range(rounds if n else 0):

        def add_up(batches: Iterator[pa.RecordBatch], centres: np.ndarray = centres) -> Iterator[pa.RecordBatch]:
            counts, sums = np.zeros(n, dtype=np.int64), np.zeros((n, d), dtype=np.int64)
            for batch in batches:
                for _, tree in _trees(batch, size):
                    found = settle(tree, centres)
                    counts += found.counts
                    sums += found.sums
            name, axis = np.indices(sums.shape)
            yield pa.RecordBatch.from_arrays([pa.array(x.ravel()) for x in (name, axis, sums, np.repeat(counts, d))], ["cluster", "axis", "total", "n"])

        told = trees.mapInArrow(add_up, "cluster long, axis long, total long, n long").groupBy("cluster", "axis").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()  # k rows a component
        centres = centres.copy()
        for r in told:
            if r["n"]:
                centres[r["cluster"], r["axis"]] = r["total"] // r["n"]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, tree in _trees(batch, size):
                cluster = settle(tree, centres).cluster
                apart = ((tree.points - centres[cluster]) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays([ids, pa.array(cluster), pa.array(apart)], ["id", "cluster", "distance"])

    found = cut_lineage((trees if n else trees.limit(0)).mapInArrow(assign, f"id {id_type}, cluster int, distance long"))
    inertia = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres.tolist()]
    facts = spark.createDataFrame([(c, s, sum(inertia.values()), digest[c]) for c, s in sorted(inertia.items())], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")

"""Vector operators: similarity, top-k, pairs, centroids, k-means, checks.

Defined results: a vector that is null, ragged, not finite or (nearly) zero has cosine 0 to
every other; searches, pairs and clusters leave it out. Ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import cut_lineage

MAX_QUERIES = 20_000  # rows of a query set that is sent to every task; larger ones are dealt
TILE = 1_024  # queries of one matrix product
ITEMS = 1_024  # items of one matrix product
PART_ROWS = 100_000  # items that a task holds while dealt queries pass by
PASSING = 16_384  # dealt queries, about, that pass by in one task


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for nulls, other lengths, NaN, or a squared norm under 1e-10."""
    na, nb = dot(a, a), dot(b, b)
    ok = (F.size(a) == F.size(b)) & (na >= 1e-10) & (nb >= 1e-10) & ~F.isnan(dot(a, b))
    return F.when(ok, dot(a, b) / F.sqrt(na * nb)).otherwise(0.0)


def squared_distance(a: Column, b: Column) -> Column:
    """Infinity for other lengths."""
    d = F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), d).otherwise(F.lit(float("inf")))


def first_bad(v: Column) -> Column:
    """Place (from 1) of the first component that is null, NaN or infinite; 0 if none."""
    bad = F.transform(doubles(v), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.array_position(bad, True)


def diagnostics(vectors: DataFrame, files: DataFrame, size: int, *, id_col: str = "vec_id", vec_col: str = "embedding", most: int = 5) -> DataFrame:
    """One row of counts: vectors in all, with and without one, zero, of another size, ``orphaned`` (no file), files ``missing`` theirs, ``eligible`` for search.

    ``sample`` are the ``most`` smallest ids that are not eligible. ``files``: (id).
    """
    v = F.col(vec_col)
    has = F.coalesce(F.size(v) > 0, F.lit(False))
    zero = has & F.coalesce(F.forall(v, lambda x: x == 0), F.lit(False))
    good = F.coalesce((F.size(v) == size) & (first_bad(v) == 0) & ~zero, F.lit(False))
    rows = vectors.select(F.col(id_col).alias("id"), has.alias("has"), zero.alias("zero"), (has & (F.size(v) != size)).alias("wrong"), good.alias("good"), F.lit(True).alias("here"))
    both = rows.join(files.select(F.col(id_col).alias("id")).distinct().withColumn("file", F.lit(True)), "id", "full")
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    here = F.col("here").isNotNull()
    bad = rows.where(~F.col("good")).orderBy("id").limit(most).agg(F.array_sort(F.collect_list("id")).alias("sample"))
    told = both.agg(
        count(here).alias("total"), count(F.col("has")).alias("with_vector"), count(here & ~F.col("has")).alias("without_vector"), count(F.col("zero")).alias("zero"), count(F.col("wrong")).alias("wrong_size"),
        count(here & F.col("file").isNull()).alias("orphaned"), count(~here).alias("missing"), count(F.col("good")).alias("eligible"),
    )
    return told.withColumn("sample", bad.scalar())


def pad_or_truncate(v: Column, n: int) -> Column:
    return F.when(F.size(v) > 0, F.slice(F.concat(doubles(v), F.array_repeat(F.lit(0.0), n)), 1, n))


def sanitise(v: Column) -> Column:
    """Components that aren't finite become 0; null if none is finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.when(F.exists(doubles(v), finite), F.transform(doubles(v), lambda x: F.when(finite(x), x).otherwise(0.0)))


def width(df: DataFrame, vec_col: str) -> int:
    """The most frequent length of the collection's vectors, the larger of equals; 0 for none."""
    sizes = df.where(F.size(vec_col) > 0).groupBy(F.size(vec_col).alias("n")).agg(F.count("*").alias("c"))
    first = sizes.orderBy(F.desc("c"), F.desc("n")).first()
    return first["n"] if first else 0


def well_formed(df: DataFrame, vec_col: str, size: int) -> DataFrame:
    """Without rows whose vector is null, of another length, not finite or zero."""
    return df.where((F.size(vec_col) == size) & (first_bad(F.col(vec_col)) == 0) & (dot(F.col(vec_col), F.col(vec_col)) >= 1e-10))


def _unit(v: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, norm, out=np.zeros_like(v, dtype=float), where=norm >= 1e-5)


def _stacked(v: pd.Series) -> np.ndarray:
    return _unit(np.stack(v.to_list()))


def _best(queries: np.ndarray, matrix: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int | None, min_score: float | None, edge: np.ndarray | None = None) -> Iterator[pd.DataFrame]:
    """(query, id, score) of the k best items of each query, all that tie at the edge among them; all items without k.

    ``edge`` has a score for each query that is reached by k items already. A product has
    ``TILE`` by ``ITEMS`` cells at most, whatever the number of queries and the size of a batch;
    each gives its own k best.
    """
    for b in range(0, len(v), ITEMS):
        some, names = v[b : b + ITEMS], ids[b : b + ITEMS]
        for a in range(0, len(matrix), TILE):
            s = matrix[a : a + TILE] @ some.T
            keep = np.ones_like(s, dtype=bool) if min_score is None else s >= min_score
            if edge is not None:
                keep &= s >= edge[a : a + TILE, None] - 1e-12
            if k is not None and k < s.shape[1]:
                rows = np.flatnonzero(keep.sum(1) > k)  # others keep what passes
                for r in range(0, len(rows), 128):
                    few = rows[r : r + 128]
                    low = np.partition(s[few], s.shape[1] - k, axis=1)[:, s.shape[1] - k]
                    keep[few] &= s[few] >= low[:, None] - 1e-12
            q, i = np.nonzero(keep)
            yield pd.DataFrame({"query": queries[a + q], "id": names[i], "score": s[q, i]})


def _first(rows: pd.DataFrame, k: int) -> pd.DataFrame:
    return rows.sort_values(["query", "score", "id"], ascending=[True, False, True]).groupby("query").head(k)


class Running:
    """The k best of each query so far: rows gather until they are many, and are then cut to k a query, whose last score is the edge for those to come."""

    def __init__(self, queries: np.ndarray, k: int) -> None:
        self.k, self.queries, self.order = k, queries, np.argsort(queries)
        self.edge, self.parts, self.n = np.full(len(queries), -np.inf), [], 0

    def add(self, rows: pd.DataFrame) -> None:
        if len(rows):
            self.parts.append(rows)
            self.n += len(rows)
            if self.n > 3 * self.k * len(self.queries) + 10_000:
                self.cut()

    def cut(self) -> pd.DataFrame | None:
        if not self.parts:
            return None
        kept = _first(pd.concat(self.parts), self.k)
        self.parts, self.n = [kept], len(kept)
        query, score = kept["query"].to_numpy(), kept["score"].to_numpy()
        last = np.flatnonzero(np.append(query[1:] != query[:-1], True))
        full = last[np.diff(np.append(-1, last)) == self.k]
        at = self.order[np.searchsorted(self.queries, query[full], sorter=self.order)]
        self.edge[at] = score[full]
        return kept


FOUND = "query long, id long, score double"


def scores(items: DataFrame, queries: DataFrame, k: int | None, *, id_col: str = "vec_id", vec_col: str = "embedding", min_score: float | None = None, where: Column | None = None, max_queries: int = MAX_QUERIES) -> DataFrame:
    """(query, id, score) by cosine: what may be among the k best of each query, or all that reach ``min_score``.

    A query set of ``max_queries`` rows at most (counted first) goes to all tasks as one
    matrix. A larger one is dealt: items are cut into parts of about ``PART_ROWS`` rows and
    queries into slices of about ``PASSING``; every part meets every slice once, in one task that
    holds the part while the slice passes by. So there are more tasks with more rows of either
    kind, and no longer ones. Either way a task sends on k rows a query at most, and ties at the edge.
    """
    size = width(items, vec_col)
    rows = items if where is None else items.where(where)
    rows = well_formed(rows, vec_col, size).select(F.col(id_col).alias("id"), doubles(F.col(vec_col)).alias("v"))
    asked = well_formed(queries, "embedding", size).select(F.col("query").cast("long").alias("query"), doubles(F.col("embedding")).alias("v"))
    known = asked.limit(max_queries + 1).collect() if size else []
    if size and len(known) <= max_queries:
        names, matrix = np.array([r["query"] for r in known], dtype=np.int64), _unit(np.array([r["v"] for r in known], dtype=float).reshape(-1, size))
        sent = items.sparkSession.sparkContext.broadcast((names, matrix))

        def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            names, matrix = sent.value
            running = None if k is None else Running(names, k)
            for batch in batches:
                if not len(batch):
                    continue
                for part in _best(names, matrix, batch["id"].to_numpy(), _stacked(batch["v"]), k, min_score, None if running is None else running.edge):
                    if running is None:
                        yield part
                    else:
                        running.add(part)
            if running is not None and (kept := running.cut()) is not None:
                yield kept

        return rows.mapInPandas(best, FOUND)
    if not size:
        return rows.select(F.lit(0).cast("long").alias("query"), F.col("id").cast("long").alias("id"), F.lit(0.0).alias("score")).limit(0)
    parts = max(1, -(-rows.count() // PART_ROWS))
    slices = max(1, -(-asked.count() // PASSING))
    number = lambda name, n: F.pmod(F.xxhash64(name), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    held = rows.select(number("id", parts).alias("part"), every(slices).alias("slice"), F.lit(0).alias("kind"), "id", "v")
    passing = asked.select(every(parts).alias("part"), number("query", slices).alias("slice"), F.lit(1).alias("kind"), F.col("query").alias("id"), "v")
    cells = held.unionByName(passing).withColumn("part", F.col("part") * slices + F.col("slice")).drop("slice")
    dealt = cells.repartitionById(parts * slices, "part").sortWithinPartitions("part", "kind")  # a cell of part and slice for each task

    def pass_by(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, ids, vectors = None, [], []
        for batch in batches:
            for (part, kind), rows in batch.groupby(["part", "kind"], sort=True):
                if part != now:
                    now, ids, vectors = part, [], []
                if kind == 0:
                    ids.append(rows["id"].to_numpy())
                    vectors.append(_stacked(rows["v"]))
                elif ids:
                    if len(ids) > 1:
                        ids, vectors = [np.concatenate(ids)], [np.concatenate(vectors)]
                    for a in range(0, len(rows), 64):  # 64 queries by a part of items at a time
                        some = rows.iloc[a : a + 64]
                        found = _best(some["id"].to_numpy(), _stacked(some["v"]), ids[0], vectors[0], k, min_score)
                        if k is None:
                            yield from found
                        else:
                            yield _first(pd.concat(list(found)), k)

    return dealt.mapInPandas(pass_by, FOUND)


def top_k(items: DataFrame, queries: DataFrame, k: int, *, id_col: str = "vec_id", vec_col: str = "embedding", min_score: float | None = None, where: Column | None = None, max_queries: int = MAX_QUERIES) -> DataFrame:
    """(query, id, score, rank): the k nearest items by cosine of every query, given as (query, embedding).

    ``where`` is a predicate on the items, which reaches their scan.
    """
    found = scores(items, queries, k, id_col=id_col, vec_col=vec_col, min_score=min_score, where=where, max_queries=max_queries)
    w = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query", F.col("id").alias(id_col), "score", "rank")


def chunk_search(chunks: DataFrame, queries: DataFrame, *, files: int = 20, chunks_each: int = 80, id_col: str = "vec_id", vec_col: str = "embedding", file: Column, min_score: float | None = None, hits: DataFrame | None = None) -> DataFrame:
    """(query, file, score, rank, chunk): the nearest ``chunks_each`` chunks, the best one for each file, the best files.

    ``hits`` are the result of ``top_k`` where that is known, of as many chunks or more.
    """
    if hits is None:
        hits = top_k(chunks, queries, chunks_each, id_col=id_col, vec_col=vec_col, min_score=min_score)
    hits = hits.where(F.col("rank") <= chunks_each)
    first = F.min_by(id_col, "rank").alias("chunk")
    best = hits.groupBy("query", file.alias("file")).agg(F.max("score").alias("score"), first)
    w = Window.partitionBy("query").orderBy(F.desc("score"), "file")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= files).select("query", "file", "score", "rank", "chunk")


def folder_search(folders: DataFrame, queries: DataFrame, k: int = 5, *, schema: str, id_col: str = "folder", vec_col: str = "embedding", meta_col: str = "meta") -> DataFrame:
    """(query, folder, score, rank, meta): the nearest folders with their JSON metadata by ``schema``; nulls where it does not parse."""
    hits = top_k(folders, queries, k, id_col=id_col, vec_col=vec_col)
    return hits.join(folders.select(id_col, F.from_json(meta_col, schema).alias("meta")), id_col).select("query", id_col, "score", "rank", "meta")


def similar_pairs(df: DataFrame, threshold: float, *, id_col: str = "vec_id", vec_col: str = "embedding", tile: int | None = None) -> DataFrame:
    """(a, b, score) of all pairs a < b with a cosine of at least ``threshold``: ``operators.near``, with ``tile`` rows held by a task."""
    from corpusloom.operators import near

    return near.similar_pairs(df, threshold, id_col=id_col, vec_col=vec_col, residents=tile)


def centroids(df: DataFrame, group: str, *, vec_col: str = "embedding") -> DataFrame:
    """Element-wise means, summed before the shuffle."""
    cells = df.select(group, F.posexplode(doubles(F.col(vec_col))).alias("at", "x")).groupBy(group, "at").agg(F.avg("x").alias("x"))
    ordered = F.sort_array(F.collect_list(F.struct("at", "x")))
    return cells.groupBy(group).agg(F.transform(ordered, lambda c: c["x"]).alias("centroid"))


def assign_nearest(df: DataFrame, centres: list[tuple[int, list[float]]], *, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, cluster, distance): the nearest of a few centres by squared distance, the lowest name of equals."""
    centres = sorted(centres)
    names, matrix = np.array([c for c, _ in centres]), np.array([v for _, v in centres])

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                at, exact = _nearest(np.stack(batch["v"].to_list()), matrix)
                yield pd.DataFrame({"id": batch["id"], "cluster": names[at], "distance": exact})

    rows = well_formed(df, vec_col, len(centres[0][1])) if centres else df.limit(0)
    out = rows.select(F.col(id_col).alias("id"), doubles(F.col(vec_col)).alias("v")).mapInPandas(assign, "id long, cluster long, distance double")
    return out.withColumnRenamed("id", id_col)


def _nearest(v: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = (v**2).sum(1)[:, None] - 2 * v @ centres.T + (centres**2).sum(1)[None, :]
    at = d.argmin(axis=1)
    return at, ((v - centres[at]) ** 2).sum(axis=1)


def best_of_few(files: DataFrame, folders: list[tuple[int, list[float]]], k: int | None, *, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, folder, score) of the k best (or all) of the given folders for every file; nothing is shuffled.

    For folders that are one row a cluster; more than ``MAX_QUERIES`` of them are searched with
    ``top_k``, folders as items and files as queries.
    """
    if len(folders) > MAX_QUERIES:
        raise ValueError("so many folders are a collection: search it with top_k")
    folders = sorted(folders)
    names, matrix = np.array([f for f, _ in folders]), _unit(np.array([v for _, v in folders]))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a in range(0, len(batch), TILE):
                some = batch.iloc[a : a + TILE]
                s = _stacked(some["v"]) @ matrix.T
                at = np.argsort(-s, axis=1, kind="stable")[:, :k]
                yield pd.DataFrame({"id": np.repeat(some["id"].to_numpy(), at.shape[1]), "folder": names[at].ravel(), "score": np.take_along_axis(s, at, 1).ravel()})

    rows = well_formed(files, vec_col, len(folders[0][1])) if folders else files.limit(0)
    out = rows.select(F.col(id_col).alias("id"), doubles(F.col(vec_col)).alias("v")).mapInPandas(score, "id long, folder long, score double")
    return out.withColumnRenamed("id", id_col)


def best_folders(files: DataFrame, folders: DataFrame, k: int | None, *, id_col: str = "vec_id", vec_col: str = "embedding", max_queries: int = MAX_QUERIES) -> DataFrame:
    """(id, folder, score) of the k best (or all) of any number of folders (folder, embedding) for every file.

    Up to ``max_queries`` folders (counted first) are one matrix in every task; more of them are
    items that all files pass by, a part of them in a task.
    """
    known = folders.select("folder", "embedding").limit(max_queries + 1).collect()
    if len(known) <= max_queries:
        return best_of_few(files, [(r["folder"], list(r["embedding"])) for r in known], k, id_col=id_col, vec_col=vec_col)
    asked = files.select(F.col(id_col).cast("long").alias("query"), F.col(vec_col).alias("embedding"))
    found = scores(folders, asked, k, id_col="folder", vec_col="embedding", min_score=None if k else -2.0, max_queries=max_queries)
    if k:
        w = Window.partitionBy("query").orderBy(F.desc("score"), "id")
        found = found.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k)
    return found.select(F.col("query").alias(id_col), F.col("id").alias("folder"), "score")


def bridges(files: DataFrame, clusters: DataFrame, *, threshold: float, least: float = 0.5, margin: float = 0.1, members: int | None = 50, most: int = 3, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(label, other, id, score): for every other cluster the ``most`` members of a cluster nearest to its centre.

    With ``members`` only so many that are nearest to their own centre are looked at, without it all. A score is rounded to two
    places and reaches max(``least``, ``threshold`` - ``margin``). ``clusters``: (folder, embedding).
    """
    labels = files.select(id_col, label_col)
    s = best_folders(files, clusters, None, id_col=id_col, vec_col=vec_col).join(labels, id_col)
    if members is not None:
        s = cut_lineage(s)
        own = F.row_number().over(Window.partitionBy(label_col).orderBy(F.desc(F.round("score", 6)), id_col))
        near = s.where(F.col("folder") == F.col(label_col)).withColumn("_n", own).where(F.col("_n") <= members).select(id_col)
        s = s.join(near, id_col, "left_semi")
    s = s.where(F.col("folder") != F.col(label_col)).select(label_col, F.col("folder").alias("other"), id_col, F.round("score", 2).alias("score"))
    w = Window.partitionBy(label_col, "other").orderBy(F.desc("score"), id_col)
    return s.withColumn("_n", F.row_number().over(w)).where((F.col("_n") <= most) & (F.col("score") >= max(least, round(threshold - margin, 9)))).drop("_n")


def kmeans(df: DataFrame, k: int, *, id_col: str = "vec_id", vec_col: str = "embedding", seed: int = 7, rounds: int = 50) -> DataFrame:
    """(id, cluster, distance) of Lloyd's rounds from k rows chosen by distance-weighted draws.

    The first centres come from a bounded sample (the 5,000 smallest hashes of ids); the rounds
    are ``lloyd``'s.
    """
    df = well_formed(df, vec_col, width(df, vec_col))
    rows = df.select(F.col(id_col).alias("id"), doubles(F.col(vec_col)).alias("v"))
    sample = np.array([r["v"] for r in rows.orderBy(F.xxhash64("id"), "id").limit(5_000).collect()])
    if not len(sample):
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("cluster"), F.lit(0.0).alias("distance"))
    rng = np.random.default_rng(seed)
    chosen = [sample[rng.integers(len(sample))]]
    while len(chosen) < min(k, len(sample)):
        d = np.min([((sample - c) ** 2).sum(1) for c in chosen], axis=0)
        chosen.append(sample[rng.choice(len(sample), p=d / d.sum()) if d.sum() else rng.integers(len(sample))])
    centres = lloyd(rows, np.array(chosen), rounds=rounds)
    return cut_lineage(assign_nearest(df, [(i, c.tolist()) for i, c in enumerate(centres)], id_col=id_col, vec_col=vec_col))


def lloyd(rows: DataFrame, centres: np.ndarray, *, rounds: int = 50) -> np.ndarray:
    """Centres after rounds of (id, v): means of the nearest vectors; the vectors farthest from their centres take the places of empty clusters.

    While a task assigns its rows it adds up each cluster and remembers its farthest rows, as many
    as there could be empty clusters, so that repair needs no pass of its own. The first empty
    cluster gets the farthest vector of all (of equals the smallest id), the next one the second.
    Rounds end when no centre moves, that is when no row would change its cluster.
    """
    k = len(centres)
    schema = "cluster long, n double, far double, id long, v array<double>"
    for _ in range(rounds):

        def add_up(batches: Iterator[pd.DataFrame], centres: np.ndarray = centres) -> Iterator[pd.DataFrame]:
            sums, sizes, farthest = np.zeros_like(centres), np.zeros(k), None
            for batch in batches:
                if not len(batch):
                    continue
                v = np.stack(batch["v"].to_list())
                at, far = _nearest(v, centres)
                np.add.at(sums, at, v)
                sizes += np.bincount(at, minlength=k)
                some = pd.DataFrame({"far": far, "id": batch["id"], "v": batch["v"]})
                farthest = (some if farthest is None else pd.concat([farthest, some])).sort_values(["far", "id"], ascending=[False, True]).head(k - 1)
            yield pd.DataFrame({"cluster": np.arange(k), "n": sizes, "far": None, "id": None, "v": list(sums)})
            if farthest is not None:
                yield farthest.assign(cluster=None, n=None)[["cluster", "n", "far", "id", "v"]]

        told = cut_lineage(rows.mapInPandas(add_up, schema))
        cells = told.where("cluster IS NOT NULL").select("cluster", "n", F.posexplode("v").alias("axis", "x"))
        means = cells.groupBy("cluster", "axis").agg((F.sum("x") / F.nullif(F.sum("n"), F.lit(0.0))).alias("x")).where("x IS NOT NULL").toPandas()  # k centres
        new = centres.copy()
        new[means["cluster"].to_numpy(dtype=int), means["axis"].to_numpy(dtype=int)] = means["x"].to_numpy()
        empty = sorted({*range(k)} - {*means["cluster"].tolist()})
        if empty:
            spare = told.where("cluster IS NULL").orderBy(F.desc("far"), "id").limit(len(empty)).collect()
            for c, r in zip(empty, spare, strict=False):
                new[c] = r["v"]
        still = np.allclose(new, centres, atol=1e-9)
        centres = new
        if still:
            break
    return centres

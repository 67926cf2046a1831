"""Graphs of documents: concept co-occurrence, components, searches in breadth, capped edges."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.history import common_tags, most_frequent
from corpusloom.operators.near import group_sums, similar_pairs, unit
from corpusloom.operators.vectors import doubles, well_formed, width
from corpusloom.session import cut_lineage, drop_folder, scratch, stored


def concept_edges(docs: DataFrame, *, id_col: str = "doc_id", concepts_col: str = "concepts", per_doc: int = 20, per_concept: int = 100, min_weight: int = 2, max_edges: int | None = 2_000) -> DataFrame:
    """(source, target, weight) of documents that share at least ``min_weight`` concepts.

    The limits are the feature's own: concepts a document (first ones), documents a concept
    (smallest ids; so one concept makes at most per_concept squared / 2 rows), edges in all.
    """
    c = F.slice(F.array_distinct(F.transform(concepts_col, lambda x: F.lower(F.substring(F.trim(x), 1, 80)))), 1, per_doc)
    rows = docs.select(F.col(id_col).alias("id"), F.explode(F.filter(c, lambda x: x != "")).alias("concept"))
    w = Window.partitionBy("concept").orderBy("id")
    rows = rows.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= per_concept).drop("rn")
    pairs = rows.alias("a").join(rows.alias("b"), "concept").where("a.id < b.id")
    edges = pairs.groupBy(F.col("a.id").alias("source"), F.col("b.id").alias("target")).agg(F.count("*").alias("weight")).where(F.col("weight") >= min_weight)
    return edges.orderBy(F.desc("weight"), "source", "target").limit(max_edges) if max_edges else edges


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, by rounds of neighbours' minima and pointer jumps."""
    # Rounds are tables and no checkpoints: see capped_edges.
    with scratch(edges.sparkSession, "components") as folder:
        both = stored(edges.select(F.col("a"), F.col("b")).unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{folder}/both")
        labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")), f"{folder}/0")
        n = 0
        while True:
            n += 1
            near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("m"))
            step = labels.join(near, "node").select("node", F.least("component", "m").alias("component"))
            # Pointer jump: a label's own label, so that long chains halve each round.
            jump = step.alias("s").join(step.alias("t"), F.col("s.component") == F.col("t.node"), "left")
            new = stored(jump.select(F.col("s.node").alias("node"), F.coalesce(F.col("t.component"), F.col("s.component")).alias("component")), f"{folder}/{n}")
            moved = new.join(labels.withColumnRenamed("component", "old"), "node").where("component <> old").limit(1).count()
            labels = new
            drop_folder(edges.sparkSession, f"{folder}/{n - 1}")
            if not moved:
                return cut_lineage(labels)


def pair_groups(df: DataFrame, threshold: float, *, id_col: str = "vec_id", vec_col: str = "embedding", residents: int | None = None) -> DataFrame:
    """(component, size, mean): groups that all pairs with a cosine of ``threshold`` or more link, and their mean cosine to two places.

    Every pair is compared and counts, but none is a row: see ``group_sums``. Only where ids repeat, pairs are made.
    """
    spark = df.sparkSession
    df = df.where(F.col(id_col).isNotNull())
    with scratch(spark, "groups") as folder:
        if df.groupBy(id_col).count().where("count > 1").isEmpty():
            links, nodes = group_sums(df, threshold, id_col=id_col, vec_col=vec_col, residents=residents)
        else:
            pairs = similar_pairs(df, threshold, id_col=id_col, vec_col=vec_col, residents=residents).where("a < b")
            links, nodes = pairs.select("a", "b", F.col("score").alias("sum"), F.lit(1).cast("long").alias("pairs")), None
        links = stored(links, f"{folder}/links")
        c = connected_components(links.select("a", "b"))
        mean = links.join(c, F.col("a") == F.col("node")).groupBy("component").agg(F.round(F.sum("sum") / F.sum("pairs"), 2).alias("mean"))
        size = (c.withColumn("size", F.lit(1)) if nodes is None else c.join(nodes, "node")).groupBy("component").agg(F.sum("size").alias("size"))
        return cut_lineage(size.join(mean, "component").select("component", "size", "mean"))


def within_hops(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(node, hop): nodes reached from the seeds over undirected edges (a, b), by the fewest hops."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    seen = seeds.select("node").distinct().withColumn("hop", F.lit(0))
    front = seen
    for k in range(1, hops + 1):
        front = front.join(both, F.col("node") == F.col("a")).select(F.col("b").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("hop", F.lit(k))
        seen = seen.unionByName(front)
    return seen


def touching_edges(edges: DataFrame, seeds: DataFrame, most: int = 2_000) -> DataFrame:
    """Edges (a, b, weight) with an end among the seeds (node), the heaviest first, ``most`` at most."""
    one, two = (edges.join(seeds.select(F.col("node").alias(end)).distinct(), end, "left_semi") for end in ("a", "b"))
    return one.unionByName(two).distinct().orderBy(F.desc("weight"), "a", "b").limit(most)


def neighbour_edges(edges: DataFrame, seeds: DataFrame, *, min_weight: float = 0.0, max_edges: int = 2_000, max_neighbours: int = 200) -> DataFrame:
    """(a, b, weight, neighbour): edges with an end among the seeds (node), taken by weight, with caps on edges and new neighbours.

    Taken one by one, an edge to a new neighbour is left out when there are ``max_neighbours``
    already. So the neighbours are those that appear first, whatever comes later: the smallest of
    each one's edges in the order, the first ``max_neighbours`` of these, then the first
    ``max_edges`` edges to a seed or one of them. Nothing is sorted as a whole. ``neighbour`` is
    the other end, null between two seeds. Repeated edges count once.
    """
    node = seeds.select(F.col("node").alias("_node")).distinct().withColumn("_seed", F.lit(True))
    rows = edges.where(F.col("weight") >= min_weight).select("a", "b", "weight").distinct()
    for end in ("a", "b"):
        rows = rows.join(node.select(F.col("_node").alias(end), F.col("_seed").alias(f"_{end}")), end, "left")
    rows = rows.where("_a IS NOT NULL OR _b IS NOT NULL")
    rows = cut_lineage(rows.select("a", "b", "weight", F.when(F.col("_a").isNull(), F.col("a")).when(F.col("_b").isNull(), F.col("b")).alias("neighbour")))
    order = F.struct((-F.col("weight")).alias("w"), "a", "b")
    first = rows.where("neighbour IS NOT NULL").groupBy("neighbour").agg(F.min(order).alias("_first")).orderBy("_first").limit(max_neighbours).select("neighbour", F.lit(True).alias("_in"))
    taken = rows.join(F.broadcast(first), "neighbour", "left").where("neighbour IS NULL OR _in")  # max_neighbours rows
    return taken.orderBy(F.desc("weight"), "a", "b").limit(max_edges).select("a", "b", "weight", "neighbour")


def cluster_terms(members: DataFrame, fields: dict[str, int], *, most: int = 10, tokens: int = 80, chars: int = 5_000, least: int = 4) -> DataFrame:
    """(cluster, term, score): the ``most`` telling terms of each cluster, given as rows (cluster, fields).

    A term counts with its field's weight, in the first ``tokens`` terms of the first ``chars``
    characters of a field (the feature's limits), times ln((clusters + 1) / (clusters with it + 1)).
    """
    each = lambda f, w: F.transform(F.slice(F.regexp_extract_all(F.lower(F.substring(F.coalesce(F.col(f).cast("string"), F.lit("")), 1, chars)), F.lit(f"([a-z]{{{least},}})"), 1), 1, tokens), lambda t: F.struct(t.alias("term"), F.lit(w).alias("w")))
    rows = members.select("cluster", F.explode(F.concat(*(each(f, w) for f, w in fields.items()))).alias("t"))
    tf = rows.groupBy("cluster", F.col("t.term").alias("term")).agg(F.sum("t.w").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    n = members.select((F.count_distinct("cluster") + 1.0).alias("n")).scalar()
    s = tf.join(df, "term").withColumn("score", F.col("tf") * F.log(n / (F.col("df") + 1))).where("score > 0")
    first = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("score"), "term"))
    return s.withColumn("_n", first).where(F.col("_n") <= most).select("cluster", "term", "score")


def cluster_labels(members: DataFrame, *, share: float = 0.4) -> DataFrame:
    """(cluster, name, confidence) of rows (cluster, id, category, tags): the first rung that holds.

    The two most common tags and the most frequent category, or the category alone (medium);
    three tags, or the cluster's number from 1 (low). A tag is common that ``share`` of the members have.
    """
    tags = common_tags(members, "cluster", id_col="id", share=share).where("rank <= 3")
    told = tags.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("rank", "tag"))).alias("t"))
    names = F.transform("t", lambda x: x["tag"])
    best = most_frequent(members, "cluster", "category", "id").select("cluster", "category")
    j = members.select("cluster").distinct().join(told, "cluster", "left").join(best, "cluster", "left")
    name = F.when(F.col("category").isNotNull(), F.concat_ws(" ", F.array_join(F.slice(names, 1, 2), " "), "category"))
    name = name.when(F.col("t").isNotNull(), F.array_join(names, ", ")).otherwise(F.concat(F.lit("Cluster "), (F.col("cluster") + 1).cast("string")))
    return j.select("cluster", F.trim(name).alias("name"), F.when(F.col("category").isNotNull(), "medium").otherwise("low").alias("confidence"))


def expand_hops(seeds: DataFrame, edges: DataFrame | Callable[[DataFrame], DataFrame], hops: int = 2, decay: float = 0.7, k: int | None = None) -> DataFrame:
    """(seed, node, score, hop): best path's score; a hop multiplies by similarity and decay to the hop's power.

    With ``k`` a hop follows the ``k`` most similar neighbours of a node, of equals the smallest.

    ``seeds``: (node); ``edges``: (node, neighbour, sim), or a function that gives those of the
    nodes (node) that a hop starts from. Only a node's first visit goes on.
    """
    seen = seeds.select(F.col("node").alias("seed"), "node", F.lit(1.0).alias("score"), F.lit(0).alias("hop"))
    front = seen
    for hop in range(1, hops + 1):
        of_front = edges(cut_lineage(front.select("node").distinct())) if callable(edges) else edges
        if k is not None:
            nearest = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("sim"), "neighbour"))
            of_front = of_front.withColumn("_n", nearest).where(F.col("_n") <= k).drop("_n")
        step = front.join(of_front, "node").select("seed", F.col("neighbour").alias("node"), (F.col("score") * F.col("sim") * (decay**hop)).alias("score"))
        front = step.groupBy("seed", "node").agg(F.max("score").alias("score")).join(seen.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("hop", F.lit(hop))
        seen = seen.unionByName(front)
    return seen.where("hop > 0")


BLOCK_NODES, NEAREST = 32_768, 64  # of capped_edges: nodes of a block, and their edges looked at together


def capped_edges(edges: DataFrame, cap: int = 3, *, nodes: int = BLOCK_NODES, nearest: int = NEAREST) -> DataFrame:
    """(a, b, score): edges taken in order (a, b) while both ends have fewer than ``cap``.

    Edges are dealt to blocks of about ``nodes`` values of a, in their order. What earlier blocks
    took is known for a block, so Spark drops edges to full ends and keeps the ``nearest`` next
    ones of each a; one task takes these few in order. An a that finds all of them full by then,
    and has more, ends that pass, and the next one goes on after them with twice as many. So the
    number of passes is that of blocks and such ends, and the driver sees one row of each. A
    round for all that can be decided at once would need 113 of them for 425,276 edges of
    10,256 vectors, and more with more vectors.
    """
    with scratch(edges.sparkSession, "capped") as folder:
        return cut_lineage(_capped_edges(edges, cap, nodes, max(nearest, cap), folder))


def _capped_edges(edges: DataFrame, cap: int, nodes: int, nearest: int, folder: str) -> DataFrame:
    spark = edges.sparkSession
    first = stored(edges.where("a <> b").groupBy(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).agg(F.max("score").alias("score")), f"{folder}/edges")
    starts = first.select(F.col("a").cast("double").alias("a")).distinct()
    blocks = max(1, -(-starts.count() // nodes))
    bounds = sorted(set(starts.approxQuantile("a", [k / blocks for k in range(1, blocks)], 0.05 / blocks))) if blocks > 1 else []
    block = F.size(F.filter(F.lit(bounds), lambda x: x < F.col("a"))) if bounds else F.lit(0)
    first.withColumn("block", block).repartition("block", F.col("a") % 16).write.option("compression", "zstd").partitionBy("block").parquet(f"{folder}/blocks")
    drop_folder(spark, f"{folder}/edges")
    schema = "a long, b long, score double, stop boolean"
    used = spark.createDataFrame([], "node long, used int")
    taken: list[str] = []

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count: dict[int, int] = {}
        for batch in batches:
            out: list[int] = []
            stop = None
            for k, (a, b, ua, ub, more) in enumerate(zip(*(batch[c].tolist() for c in ("a", "b", "ua", "ub", "more")), strict=True)):
                na, nb = count.get(a, ua), count.get(b, ub)
                if na < cap and nb < cap:
                    count[a], count[b] = na + 1, nb + 1
                    out.append(k)
                if more and count.get(a, ua) < cap:  # its last edge here, but not its last one
                    stop = (a, b)
                    break
            yield batch.iloc[out][["a", "b", "score"]].assign(stop=False)
            if stop is not None:
                yield pd.DataFrame({"a": [stop[0]], "b": [stop[1]], "score": [0.0], "stop": [True]})
                return

    for k in range(len(bounds) + 1):
        of_block = spark.read.schema("a long, b long, score double, block int").parquet(f"{folder}/blocks").where(F.col("block") == k).drop("block")
        begin, wide = None, nearest
        while True:
            left = of_block if begin is None else of_block.where((F.col("a") > begin["a"]) | (F.col("a") == begin["a"]) & (F.col("b") > begin["b"]))
            for end in ("a", "b"):
                left = left.join(used.select(F.col("node").alias(end), F.col("used").alias(f"u{end}")), end, "left").withColumn(f"u{end}", F.coalesce(f"u{end}", F.lit(0))).where(F.col(f"u{end}") < cap)
            order = Window.partitionBy("a").orderBy("b")
            near = left.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= wide + 1).withColumn("more", (F.col("_n") == wide) & F.lead("b").over(order).isNotNull()).where(F.col("_n") <= wide)
            ordered = near.select("a", "b", "score", "ua", "ub", "more").repartition(1).sortWithinPartitions("a", "b")  # a block's nearest edges, no more
            taken.append(f"{folder}/taken-{len(taken)}")
            got = stored(ordered.mapInPandas(take, schema), taken[-1])
            counts = got.where("NOT stop").select(F.explode(F.array("a", "b")).alias("node"), F.lit(1).alias("used")).unionByName(used)
            used = stored(counts.groupBy("node").agg(F.sum("used").cast("int").alias("used")), f"{folder}/used-{len(taken)}")
            ended = got.where("stop").first()
            if len(taken) > 1:
                drop_folder(spark, f"{folder}/used-{len(taken) - 1}")
            if ended is None:
                break
            begin, wide = ended, min(2 * wide, 16 * nearest)
    return spark.read.schema(schema).parquet(*taken).where("NOT stop").select("a", "b", "score")


ROWS, MOST_ROWS, JOBS = 16_384, 65_536, 32  # of capped_pairs: vectors of a block, or up to the second number where there are more blocks than the third
OPEN = 32_768  # earlier vectors with fewer edges than the cap that a block is compared with
STEP, AT_ONCE = 256, 4_096  # new vectors and open ones of a product


def capped_pairs(df: DataFrame, threshold: float, cap: int = 3, *, id_col: str = "vec_id", vec_col: str = "embedding", rows: int | None = None, most_open: int = OPEN) -> DataFrame:
    """(a, b, score): the edges that ``capped_edges`` takes of all pairs with a cosine of ``threshold`` or more, without making these pairs.

    An edge is taken when both ends have fewer than ``cap``, so only vectors that are still open matter. They come in the
    order of their ids, in blocks, each met by the open ones before it, in their order, and by itself: whether (a, b) is taken
    depends on edges (a, smaller b) and (smaller a, b) alone, which come before it. A block is a task of a bounded number of
    rows, and one follows the other. Where vectors find partners few stay open, and the work grows with their number. Where
    more than ``most_open`` stay open, or ids repeat, all pairs are made, by ``similar_pairs``: nothing is left out.
    """
    spark = df.sparkSession
    with scratch(spark, "capped") as folder:
        found = well_formed(df, vec_col, width(df, vec_col)).select(F.col(id_col).cast("long").alias("id"), doubles(F.col(vec_col)).alias("v")).where("id IS NOT NULL")
        first = stored(found, f"{folder}/vectors")
        n = first.count()
        repeated = not first.groupBy("id").count().where("count > 1").isEmpty()
        taken = None if repeated or not n else _capped_pairs(first, n, threshold, cap, rows or min(MOST_ROWS, max(ROWS, -(-n // JOBS))), most_open, folder)
        if taken is not None:
            return cut_lineage(taken)
    return capped_edges(similar_pairs(df, threshold, id_col=id_col, vec_col=vec_col), cap)


def _capped_pairs(first: DataFrame, n: int, threshold: float, cap: int, rows: int, most_open: int, folder: str) -> DataFrame | None:
    """The edges, or nothing where too many vectors stay open."""
    spark = first.sparkSession
    blocks = max(1, -(-n // rows))
    at = F.col("id").cast("double")
    bounds = sorted(set(first.select(at.alias("id")).approxQuantile("id", [k / blocks for k in range(1, blocks)], 0.05 / blocks))) if blocks > 1 else []
    block = F.size(F.filter(F.lit(bounds), lambda x: x < at)) if bounds else F.lit(0)
    first.withColumn("block", block).repartition("block").write.option("compression", "zstd").partitionBy("block").parquet(f"{folder}/blocks")
    schema = "a long, b long, score double, used int, v array<double>"  # an edge, or an open vector a

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, used, raw, v = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, object), None  # open ones, by id
        out: list[tuple[int, int, float]] = []

        def meet(a: np.ndarray, va: np.ndarray, ua: np.ndarray, b: np.ndarray, vb: np.ndarray, ub: np.ndarray) -> None:
            near = va @ vb.T >= threshold - 1e-9
            x, y = np.nonzero(np.triu(near, 1) if a is b else near)
            s = np.einsum("ij,ij->i", va[x], vb[y])
            keep = s >= threshold - 1e-12
            for i, j, score in zip(x[keep].tolist(), y[keep].tolist(), s[keep].tolist(), strict=True):
                if ua[i] < cap and ub[j] < cap:
                    ua[i] += 1
                    ub[j] += 1
                    out.append((int(a[i]), int(b[j]), score))

        for batch in batches:
            for k in range(0, len(batch), STEP):
                some = batch.iloc[k : k + STEP]
                new, u, w, vectors = some["id"].to_numpy(), some["used"].to_numpy().astype(np.int64), some["v"].to_numpy(), unit(some["v"])
                met = some["old"].to_numpy().astype(bool)  # each other, in the blocks before
                for those in (met, ~met):
                    if not those.any():
                        continue
                    b, ub, wb, vb = new[those], u[those], w[those], vectors[those]
                    v = vb[:0] if v is None else v
                    if those is not met:
                        for at in range(0, len(ids), AT_ONCE):
                            part, left = slice(at, at + AT_ONCE), np.flatnonzero(ub < cap)
                            now = ub[left]
                            meet(ids[part], v[part], used[part], b[left], vb[left], now)
                            ub[left] = now
                        meet(b, vb, ub, b, vb, ub)
                        if (used >= cap).any():
                            old = used < cap
                            ids, used, raw, v = ids[old], used[old], raw[old], v[old]
                    stay = ub < cap
                    ids, used, raw, v = np.concatenate([ids, b[stay]]), np.concatenate([used, ub[stay]]), np.concatenate([raw, wb[stay]]), np.concatenate([v, vb[stay]])
                if len(ids) > most_open:
                    yield pd.DataFrame({"a": [None], "b": [None], "score": [None], "used": [-1], "v": [None]}).astype({"a": "Int64", "b": "Int64", "used": "Int32"})
                    return
            a, b, score = zip(*out, strict=True) if out else ((), (), ())
            yield pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64), "score": np.array(score, float), "used": np.int32(0), "v": None})
            out.clear()
        for k in range(0, len(ids), AT_ONCE):
            part = slice(k, k + AT_ONCE)
            yield pd.DataFrame({"a": ids[part], "b": pd.array([None] * len(ids[part]), "Int64"), "score": 0.0, "used": used[part].astype(np.int32), "v": list(raw[part])})

    taken: list[str] = []
    for k in range(len(bounds) + 1):
        now = spark.read.schema("id long, v array<double>, block int").parquet(f"{folder}/blocks").where(F.col("block") == k).select("id", "v", F.lit(0).alias("used"), F.lit(False).alias("old"))
        if taken:
            open_ = spark.read.schema(schema).parquet(taken[-1]).where("b IS NULL")
            now = now.unionByName(open_.select(F.col("a").alias("id"), "v", "used", F.lit(True).alias("old")))
        taken.append(f"{folder}/taken-{k}")
        got = stored(now.repartition(1).sortWithinPartitions("id").mapInPandas(take, schema), taken[-1])  # a block, and the open ones
        if not got.where("used < 0").isEmpty():
            return None
    return spark.read.schema(schema).parquet(*taken).where("b IS NOT NULL").select("a", "b", "score")

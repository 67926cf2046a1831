"""Queries over the vector collection; labels stand for clusters and folders."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.operators import vectors as V
from corpusloom.plans.registry import query
from corpusloom.session import table

COS = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"
#: Every row whose id is divisible by 50 is a query against all rows.
SEARCH = f"SELECT b.vec_id AS query, a.vec_id, {COS} AS score FROM embeddings a, embeddings b WHERE b.vec_id % 50 = 0"
CENTRE = "c AS (SELECT label, list(x ORDER BY pos) AS centroid FROM (SELECT label, pos, avg(CAST(embedding[pos] AS DOUBLE)) AS x FROM embeddings, (SELECT unnest(generate_series(1, 64)) AS pos) GROUP BY 1, 2) GROUP BY 1)"


def vectors(spark, sf):
    return table(spark, sf, "embeddings")


def queries(spark, sf):
    return vectors(spark, sf).where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), "embedding")


def six(c: str):
    return F.round(c, 6).alias(c)


@query("cosine_topk", f"SELECT query, vec_id, round(score, 6) AS score, round(1 - score, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS rn FROM ({SEARCH})) WHERE rn <= 10")
def cosine_topk(spark, sf):
    return V.top_k(vectors(spark, sf), queries(spark, sf), 10).select("query", "vec_id", six("score"), F.round(1 - F.col("score"), 6).alias("distance"))


@query("cosine_topk_positive", f"SELECT query, vec_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS rn FROM ({SEARCH}) WHERE score > 0) WHERE rn <= 75")
def cosine_topk_positive(spark, sf):
    return V.top_k(vectors(spark, sf), queries(spark, sf), 75, min_score=1e-15).select("query", "vec_id", six("score"))


@query("cosine_pairs", f"SELECT a.vec_id, round({COS}, 6) AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine_pairs(spark, sf):
    a, b = vectors(spark, sf).select("vec_id", "embedding"), vectors(spark, sf).select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return a.join(b, "vec_id").select("vec_id", F.round(V.cosine(F.col("embedding"), F.col("other")), 6).alias("score"))


@query("l2sq", "SELECT a.vec_id, round(power(list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 2), 6) AS distance FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def l2sq(spark, sf):
    a, b = vectors(spark, sf).select("vec_id", "embedding"), vectors(spark, sf).select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return a.join(b, "vec_id").select("vec_id", F.round(V.squared_distance(F.col("embedding"), F.col("other")), 6).alias("distance"))


@query("vector_validation", "SELECT vec_id, CAST(CASE WHEN vec_id % 13 = 0 THEN vec_id % 64 + 1 ELSE 0 END AS BIGINT) AS first_bad, CASE WHEN vec_id % 17 = 0 THEN 63 ELSE 64 END = 64 AS right_size FROM embeddings WHERE vec_id % 17 <> 0 OR vec_id % 13 <> 0")
def vector_validation(spark, sf):
    nan = F.transform("embedding", lambda x, i: F.when((F.col("vec_id") % 13 == 0) & (i == F.col("vec_id") % 64), float("nan")).otherwise(x))
    v = vectors(spark, sf).where("vec_id % 17 <> 0 OR vec_id % 13 <> 0").select("vec_id", F.when(F.col("vec_id") % 17 == 0, F.slice(nan, 1, 63)).otherwise(nan).alias("v"))
    return v.select("vec_id", V.first_bad(F.col("v")).alias("first_bad"), (F.size("v") == 64).alias("right_size"))


@query("pad_truncate", "SELECT vec_id, 80 AS padded, 32 AS cut, round(CAST(embedding[32] AS DOUBLE), 6) AS last_kept, 0.0 AS last_padded FROM embeddings")
def pad_truncate(spark, sf):
    p, c = V.pad_or_truncate(F.col("embedding"), 80), V.pad_or_truncate(F.col("embedding"), 32)
    return vectors(spark, sf).select("vec_id", F.size(p).alias("padded"), F.size(c).alias("cut"), F.round(F.element_at(c, -1), 6).alias("last_kept"), F.element_at(p, -1).alias("last_padded"))


@query("sanitize_vector", "SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN NULL WHEN vec_id % 5 = 0 THEN 0.0 ELSE round(CAST(embedding[1] AS DOUBLE), 6) END AS v0 FROM embeddings")
def sanitize_vector(spark, sf):
    nan = F.transform("embedding", lambda x, i: F.when((F.col("vec_id") % 7 == 0) | ((F.col("vec_id") % 5 == 0) & (i == 0)), float("nan")).otherwise(x))
    return vectors(spark, sf).select("vec_id", F.round(V.sanitise(nan)[0], 6).alias("v0"))


@query("similar_in_scope", f"""SELECT query, vec_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS r2 FROM
 (SELECT s.*, e.label, q.label AS ql, row_number() OVER (PARTITION BY query ORDER BY score DESC, s.vec_id) AS rn FROM ({SEARCH}) s JOIN embeddings e ON e.vec_id = s.vec_id JOIN embeddings q ON q.vec_id = query) WHERE rn <= 15 AND label = ql AND vec_id <> query AND score >= 0.3) WHERE r2 <= 5""")
def similar_in_scope(spark, sf):
    """Of the 3k nearest, those in the query's scope but for itself: what lies beyond 3k is lost by design."""
    labels = vectors(spark, sf).select("vec_id", "label")
    near = V.top_k(vectors(spark, sf), queries(spark, sf), 15).join(labels, "vec_id").join(labels.select(F.col("vec_id").alias("query"), F.col("label").alias("scope")), "query")
    near = near.where("label = scope AND vec_id <> query AND score >= 0.3")
    return near.withColumn("r", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).where("r <= 5").select("query", "vec_id", six("score"))


@query("score_ids", f"SELECT query, vec_id, round(score, 6) AS score FROM ({SEARCH}) WHERE vec_id IN (SELECT item_id FROM benchmark)")
def score_ids(spark, sf):
    listed = vectors(spark, sf).join(table(spark, sf, "benchmark").select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi").select("vec_id", "embedding")
    return V.scores(listed, queries(spark, sf), None).select("query", F.col("id").alias("vec_id"), six("score"))


@query("files_to_folders_topk", f"WITH {CENTRE} SELECT vec_id, folder, round(score, 6) AS score FROM (SELECT vec_id, c.label AS folder, list_cosine_similarity(CAST(embedding AS DOUBLE[]), centroid) AS score, row_number() OVER (PARTITION BY vec_id ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), centroid) DESC, c.label) AS rn FROM embeddings, c) WHERE rn <= 3")
def files_to_folders_topk(spark, sf):
    """Folders (cluster means) are few; each file's three best come from one matrix product."""
    folders = V.centroids(vectors(spark, sf), "label").select(F.col("label").cast("long").alias("folder"), F.col("centroid").alias("embedding"))
    return V.best_folders(vectors(spark, sf), folders, 3).select("vec_id", F.col("folder").cast("int").alias("folder"), six("score"))


@query("similar_to_row", f"SELECT query, vec_id, rn AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS rn FROM ({SEARCH})) WHERE rn <= 5")
def similar_to_row(spark, sf):
    return V.top_k(vectors(spark, sf), queries(spark, sf), 5).select("query", "vec_id", F.col("rank").cast("long").alias("rank"))


@query("chunk_topk", f"SELECT query, vec_id, round(score, 6) AS score, substring(d.text, 1, 240) AS snippet FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS rn FROM ({SEARCH})) JOIN documents d ON d.doc_id = vec_id WHERE rn <= 8")
def chunk_topk(spark, sf):
    hits = V.top_k(vectors(spark, sf), queries(spark, sf), 8)
    text = table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), F.substring("text", 1, 240).alias("snippet"))
    return hits.join(text, "vec_id").select("query", "vec_id", six("score"), "snippet")


@query("folder_topk", f"""WITH {CENTRE}, f AS (SELECT label AS folder, centroid, CASE WHEN label % 3 = 0 THEN 'not json' ELSE '{{"name": "folder ' || label || '", "k": ' || label || '}}' END AS meta FROM c),
 s AS (SELECT b.vec_id AS query, folder, meta, list_cosine_similarity(CAST(b.embedding AS DOUBLE[]), centroid) AS score FROM embeddings b, f WHERE b.vec_id % 50 = 0)
 SELECT query, folder, round(score, 6) AS score, CASE WHEN folder % 3 = 0 THEN NULL ELSE 'folder ' || folder END AS name, CASE WHEN folder % 3 = 0 THEN NULL ELSE CAST(folder AS BIGINT) END AS k FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, folder) AS rn FROM s) WHERE rn <= 5""")
def folder_topk(spark, sf):
    """The nearest folders of each query vector, with metadata kept as JSON; what does not parse is empty."""
    c = V.centroids(vectors(spark, sf), "label").select(F.col("label").cast("long").alias("folder"), F.col("centroid").alias("embedding"))
    meta = F.when(F.col("folder") % 3 == 0, "not json").otherwise(F.format_string('{"name": "folder %d", "k": %d}', "folder", "folder"))
    hits = V.folder_search(c.withColumn("meta", meta), queries(spark, sf), 5, schema="name string, k long")
    return hits.select("query", F.col("folder").cast("int").alias("folder"), six("score"), "meta.name", "meta.k")


@query("self_recall", f"SELECT query, true AS found FROM ({SEARCH}) WHERE query = vec_id")
def self_recall(spark, sf):
    """Every probed vector must be among its own five nearest."""
    hits = V.top_k(vectors(spark, sf), queries(spark, sf), 5)
    return hits.groupBy("query").agg(F.max(F.col("query") == F.col("vec_id")).alias("found"))


@query("vector_diagnostics", """WITH e AS (SELECT vec_id, CASE vec_id % 20 WHEN 0 THEN list_transform(embedding, lambda x: x * 0) WHEN 1 THEN embedding[1:10] WHEN 2 THEN NULL ELSE embedding END AS v FROM embeddings WHERE vec_id % 3 <> 0), f AS (SELECT doc_id FROM documents WHERE doc_id % 7 <> 0), b AS (SELECT vec_id FROM e WHERE vec_id % 20 < 3)
 SELECT (SELECT count(*) FROM e) AS total, (SELECT count(*) FROM e WHERE len(v) > 0) AS with_vector, (SELECT count(*) FROM e WHERE v IS NULL) AS without_vector, (SELECT count(*) FROM e WHERE vec_id % 20 = 0) AS zero, (SELECT count(*) FROM e WHERE vec_id % 20 = 1) AS wrong_size, (SELECT count(*) FROM e WHERE vec_id NOT IN (FROM f)) AS orphaned, (SELECT count(*) FROM f WHERE doc_id NOT IN (SELECT vec_id FROM e)) AS missing, (SELECT count(*) FROM e WHERE vec_id % 20 > 2) AS eligible, (SELECT list(vec_id ORDER BY vec_id)[1:5] FROM b) AS sample""")
def vector_diagnostics(spark, sf):
    """Vectors of which some are zero, short or missing, and files of which some are gone."""
    e = vectors(spark, sf).where("vec_id % 3 <> 0")
    k = F.col("vec_id") % 20
    v = F.when(k == 0, F.transform("embedding", lambda x: x * 0)).when(k == 1, F.slice("embedding", 1, 10)).when(k > 2, F.col("embedding"))
    files = table(spark, sf, "documents").where("doc_id % 7 <> 0").select(F.col("doc_id").alias("vec_id"))
    return V.diagnostics(e.select("vec_id", v.alias("embedding")), files, 64)


@query("centroids", "SELECT label, pos, round(avg(CAST(embedding[pos] AS DOUBLE)), 6) AS x FROM embeddings, (SELECT unnest(generate_series(1, 64)) AS pos) GROUP BY 1, 2")
def centroids(spark, sf):
    c = V.centroids(vectors(spark, sf), "label")
    return c.select("label", F.posexplode("centroid").alias("at", "x")).select("label", (F.col("at") + 1).cast("long").alias("pos"), six("x"))


@query("similarity_pairs", f"SELECT a.vec_id AS a, b.vec_id AS b, round({COS}, 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id < b.vec_id AND {COS} >= 0.4")
def similarity_pairs(spark, sf):
    return V.similar_pairs(vectors(spark, sf), 0.4).select("a", "b", six("score"))


@query("assign_nearest", f"WITH {CENTRE} SELECT vec_id, CAST(label AS BIGINT) AS cluster, round(d, 6) AS distance FROM (SELECT vec_id, c.label, power(list_distance(CAST(embedding AS DOUBLE[]), centroid), 2) AS d, row_number() OVER (PARTITION BY vec_id ORDER BY list_distance(CAST(embedding AS DOUBLE[]), centroid), c.label) AS rn FROM embeddings, c) WHERE rn = 1")
def assign_nearest(spark, sf):
    centres = [(r["label"], list(r["centroid"])) for r in V.centroids(vectors(spark, sf), "label").collect()]
    return V.assign_nearest(vectors(spark, sf), centres).select("vec_id", "cluster", six("distance"))


@query("kmeans_clusters")
def kmeans_clusters(spark, sf):
    return V.kmeans(vectors(spark, sf), 10).select("vec_id", "cluster")


@query("estimate_k", "SELECT CAST(least(15, greatest(2, ceil(sqrt(count(*) / 2.0)))) AS BIGINT) AS k FROM embeddings")
def estimate_k(spark, sf):
    return vectors(spark, sf).agg(F.least(F.lit(15), F.greatest(F.lit(2), F.ceil(F.sqrt(F.count("*") / 2)))).cast("long").alias("k"))


@query("cluster_sizes", "SELECT label, count(*) AS n FROM embeddings GROUP BY 1 HAVING count(*) >= 2")
def cluster_sizes(spark, sf):
    return vectors(spark, sf).groupBy("label").agg(F.count("*").alias("n")).where("n >= 2")


@query("cluster_members", "SELECT e.label, d.doc_id, d.source FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id")
def cluster_members(spark, sf):
    return vectors(spark, sf).join(table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), "source"), "vec_id").select("label", F.col("vec_id").alias("doc_id"), "source")


@query("outliers", f"WITH {CENTRE} SELECT e.vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), centroid), 6) AS score FROM embeddings e JOIN c USING (label) WHERE list_cosine_similarity(CAST(embedding AS DOUBLE[]), centroid) < 0.3")
def outliers(spark, sf):
    """Rows far from their own centre; centres are one row a cluster, so Spark joins them by size."""
    c = V.centroids(vectors(spark, sf), "label")
    return vectors(spark, sf).join(c, "label", "left").select("vec_id", F.coalesce(V.cosine(F.col("embedding"), F.col("centroid")), F.lit(0.0)).alias("score")).where("score < 0.3").select("vec_id", six("score"))


@query("cross_cluster_edges", f"WITH {CENTRE} SELECT a.label AS a, b.label AS b, round(list_cosine_similarity(a.centroid, b.centroid), 6) AS score FROM c a, c b WHERE a.label < b.label AND list_cosine_similarity(a.centroid, b.centroid) >= -0.05")
def cross_cluster_edges(spark, sf):
    c = V.centroids(vectors(spark, sf), "label").select(F.col("label").cast("long").alias("label"), "centroid")
    return V.similar_pairs(c, -0.05, id_col="label", vec_col="centroid").select(F.col("a").cast("int"), F.col("b").cast("int"), six("score"))


def clusters(spark, sf):
    return V.centroids(vectors(spark, sf), "label").select(F.col("label").cast("long").alias("folder"), F.col("centroid").alias("embedding"))


@query("bridge_files", f"WITH {CENTRE} SELECT label, other, vec_id, score FROM (SELECT e.label, c.label AS other, vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), c.centroid), 2) AS score, row_number() OVER (PARTITION BY e.label, c.label ORDER BY round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), c.centroid), 2) DESC, vec_id) AS rn FROM embeddings e JOIN c ON c.label <> e.label) WHERE rn <= 3 AND score >= 0.1")
def bridge_files(spark, sf):
    """Of all members of a cluster those nearest to each other cluster's centre."""
    return V.bridges(vectors(spark, sf), clusters(spark, sf), threshold=0.1, least=0.0, margin=0.0, members=None).select("label", F.col("other").cast("int").alias("other"), "vec_id", "score")


@query("semantic_duplicates", f"SELECT query, vec_id FROM ({SEARCH}) WHERE vec_id <> query AND score >= 0.35")
def semantic_duplicates(spark, sf):
    near = V.scores(vectors(spark, sf), queries(spark, sf), None, min_score=0.35)
    return near.where("id <> query").select("query", F.col("id").alias("vec_id"))


@query("semantic_folder_matches", f"WITH {CENTRE} SELECT vec_id, c.label AS folder, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), centroid) * 0.9, 5) AS score FROM embeddings, c WHERE list_cosine_similarity(CAST(embedding AS DOUBLE[]), centroid) * 0.9 >= 0.2")
def semantic_folder_matches(spark, sf):
    s = V.best_folders(vectors(spark, sf), clusters(spark, sf), None)
    return s.where("score * 0.9 >= 0.2").select("vec_id", F.col("folder").cast("int").alias("folder"), F.round(F.col("score") * 0.9, 5).alias("score"))

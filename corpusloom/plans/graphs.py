"""Queries over graphs of documents and vectors."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.operators import graph as G
from corpusloom.operators.history import duplicate_groups
from corpusloom.operators import vectors as V
from corpusloom.plans.history import HIST
from corpusloom.plans.registry import query
from corpusloom.plans.vectors import COS, six
from corpusloom.operators.history import history
from corpusloom.session import table

PAIRS = f"p AS (SELECT a.vec_id AS a, b.vec_id AS b, {COS} AS score FROM embeddings a, embeddings b WHERE a.vec_id < b.vec_id AND {COS} >= 0.35)"
EDGES = "e AS (SELECT DISTINCT least(user_id, k) AS a, greatest(user_id, k) AS b FROM (SELECT user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type = 'purchase') WHERE user_id <> k)"


def purchase_edges(spark, sf):
    e = table(spark, sf, "events").where("event_type = 'purchase'").select("user_id", F.from_json("props", "k long")["k"].alias("k")).where("user_id <> k")
    return e.select(F.least("user_id", "k").alias("a"), F.greatest("user_id", "k").alias("b")).distinct()


def concepts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{9,})"), 1).alias("concepts"))


GRAPH = """WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{9,}')) AS concept, generate_subscripts(regexp_extract_all(lower(text), '[a-z]{9,}'), 1) AS pos FROM documents),
 f AS (SELECT doc_id, concept, row_number() OVER (PARTITION BY doc_id ORDER BY min(pos)) AS k FROM t GROUP BY 1, 2),
 r AS (SELECT doc_id, concept, row_number() OVER (PARTITION BY concept ORDER BY doc_id) AS rn FROM f WHERE k <= 20),
 g AS (SELECT a.doc_id AS source, b.doc_id AS target, count(*) AS weight FROM r a JOIN r b ON a.concept = b.concept AND a.doc_id < b.doc_id WHERE a.rn <= 100 AND b.rn <= 100 GROUP BY 1, 2 HAVING count(*) >= 2),
 g2 AS (SELECT * FROM g ORDER BY weight DESC, source, target LIMIT 2000) """


@query("concept_cooccurrence", GRAPH + "SELECT source, target, weight FROM g2")
def concept_cooccurrence(spark, sf):
    return G.concept_edges(concepts(spark, sf))


@query("relationship_stats", GRAPH + "SELECT count(*) AS edges, coalesce(max(weight), 0) AS max_weight, (SELECT count(*) FROM (SELECT source FROM g2 UNION SELECT target FROM g2)) AS documents FROM g2")
def relationship_stats(spark, sf):
    g = G.concept_edges(concepts(spark, sf))
    nodes = g.select(F.col("source").alias("n")).union(g.select("target")).select(F.count_distinct("n")).scalar()
    return g.agg(F.count("*").alias("edges"), F.coalesce(F.max("weight"), F.lit(0)).alias("max_weight")).withColumn("documents", nodes)


@query("distinct_concepts", "SELECT DISTINCT concept FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{9,}')) AS concept FROM documents)")
def distinct_concepts(spark, sf):
    return concepts(spark, sf).select(F.explode("concepts").alias("concept")).distinct()


@query("near_duplicates", f"""WITH RECURSIVE {PAIRS}, bo AS (SELECT a, b FROM p UNION SELECT b, a FROM p), r(node, root) AS (SELECT DISTINCT a, a FROM bo UNION SELECT bo.b, r.root FROM r JOIN bo ON bo.a = r.node),
 c AS (SELECT node, min(root) AS component FROM r GROUP BY 1), s AS (SELECT component, count(*) AS size FROM c GROUP BY 1), m AS (SELECT component, round(avg(score), 2) AS mean FROM p JOIN c ON c.node = p.a GROUP BY 1)
 SELECT s.component, size, mean FROM s JOIN m USING (component) ORDER BY size DESC, s.component LIMIT 50""")
def near_duplicates(spark, sf):
    """Groups of vectors linked by a cosine of 0.35 or more (these data have no closer ones), the fifty largest."""
    return G.pair_groups(table(spark, sf, "embeddings"), 0.35).orderBy(F.desc("size"), "component").limit(50)


@query("similarity_edges_capped")
def similarity_edges_capped(spark, sf):
    return G.capped_pairs(table(spark, sf, "embeddings"), 0.3).select("a", "b", six("score"))


@query("multi_hop", f"""WITH knn AS (SELECT node, neighbour, sim FROM (SELECT a.vec_id AS node, b.vec_id AS neighbour, {COS} AS sim, row_number() OVER (PARTITION BY a.vec_id ORDER BY {COS} DESC, b.vec_id) AS rn FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id AND {COS} >= 0.3) WHERE rn <= 10),
 h1 AS (SELECT node AS seed, neighbour AS node, sim * 0.7 AS score FROM knn WHERE node % 50 = 0),
 h2 AS (SELECT h1.seed, k.neighbour AS node, max(h1.score * k.sim * 0.49) AS score FROM h1 JOIN knn k ON k.node = h1.node WHERE k.neighbour <> h1.seed AND NOT EXISTS (SELECT 1 FROM h1 x WHERE x.seed = h1.seed AND x.node = k.neighbour) GROUP BY 1, 2)
 SELECT seed, node, round(score, 6) AS score, 1 AS hop FROM h1 UNION ALL SELECT seed, node, round(score, 6), 2 FROM h2""")
def multi_hop(spark, sf):
    """Only nodes that a hop starts from are searched, as queries against all vectors, for their ten nearest."""
    e = table(spark, sf, "embeddings")

    def near(front):
        found = V.scores(e, e.join(front.withColumnRenamed("node", "vec_id"), "vec_id", "left_semi").select(F.col("vec_id").alias("query"), "embedding"), 11, min_score=0.3)
        return found.where("query <> id").select(F.col("query").alias("node"), F.col("id").alias("neighbour"), F.col("score").alias("sim"))

    seeds = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("node"))
    return G.expand_hops(seeds, near, k=10).select("seed", "node", six("score"), "hop")


@query("bfs_focus", f"WITH RECURSIVE {EDGES}, bo AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(node, hop) AS (SELECT 7, 0 UNION SELECT bo.b, r.hop + 1 FROM r JOIN bo ON bo.a = r.node WHERE r.hop < 2) SELECT node, min(hop) AS hop FROM r GROUP BY 1")
def bfs_focus(spark, sf):
    return G.within_hops(purchase_edges(spark, sf), spark.createDataFrame([(7,)], "node long"), 2)


@query("edges_within", f"WITH {EDGES} SELECT a, b FROM e WHERE a IN (SELECT item_id FROM benchmark) AND b IN (SELECT item_id FROM benchmark)")
def edges_within(spark, sf):
    ids = table(spark, sf, "benchmark").select("item_id")
    e = purchase_edges(spark, sf)
    return e.join(ids.withColumnRenamed("item_id", "a"), "a", "left_semi").join(ids.withColumnRenamed("item_id", "b"), "b", "left_semi").select("a", "b")


@query("neighbor_edges", f"""WITH {EDGES}, w AS (SELECT a, b, 1 + (a * 7 + b * 3) % 5 AS weight FROM e), t AS (SELECT *, CASE WHEN a NOT IN (7, 11) THEN a WHEN b NOT IN (7, 11) THEN b END AS neighbour, row_number() OVER (ORDER BY weight DESC, a, b) AS k FROM w WHERE weight >= 2 AND (a IN (7, 11) OR b IN (7, 11))),
 n AS (SELECT neighbour FROM t WHERE neighbour IS NOT NULL GROUP BY 1 ORDER BY min(k) LIMIT 12) SELECT a, b, weight, neighbour FROM t WHERE neighbour IS NULL OR neighbour IN (FROM n) ORDER BY k LIMIT 15""")
def neighbor_edges(spark, sf):
    """Twelve new neighbours of two users and fifteen edges at most, the heaviest first."""
    e = purchase_edges(spark, sf).withColumn("weight", 1 + (F.col("a") * 7 + F.col("b") * 3) % 5)
    return G.neighbour_edges(e, spark.createDataFrame([(7,), (11,)], "node long"), min_weight=2, max_edges=15, max_neighbours=12)


@query("exact_duplicates", "SELECT sha256(text) AS content_hash, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_duplicates(spark, sf):
    return duplicate_groups(table(spark, sf, "documents"), id_col="doc_id", content=F.col("text"))


@query("visible_subgraph", f"WITH {EDGES}, v AS (SELECT user_id AS node FROM events GROUP BY 1 HAVING count(*) >= 60) SELECT a, b FROM e WHERE a IN (SELECT node FROM v) AND b IN (SELECT node FROM v)")
def visible_subgraph(spark, sf):
    v = table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n")).where("n >= 60").select("user_id")
    e = purchase_edges(spark, sf)
    return e.join(v.withColumnRenamed("user_id", "a"), "a", "left_semi").join(v.withColumnRenamed("user_id", "b"), "b", "left_semi").select("a", "b")


@query("cluster_votes", HIST + ", m AS (SELECT label, count(*) AS members FROM embeddings GROUP BY 1) SELECT e.label, h.category AS folder, count(*) AS votes, round(avg(h.confidence / 100.0), 6) AS mean_score, round(count(*) * 1.0 / members, 6) AS consistency FROM embeddings e JOIN h ON h.doc_id = e.vec_id JOIN m USING (label) GROUP BY e.label, h.category, members")
def cluster_votes(spark, sf):
    e = table(spark, sf, "embeddings").select("label", F.col("vec_id").alias("doc_id"))
    m = e.groupBy("label").agg(F.count("*").alias("members"))
    v = e.join(history(spark, sf), "doc_id").groupBy("label", F.col("category").alias("folder")).agg(F.count("*").alias("votes"), F.round(F.avg(F.col("confidence") / 100), 6).alias("mean_score"))
    return v.join(m, "label").select("label", "folder", "votes", "mean_score", F.round(F.col("votes") / F.col("members"), 6).alias("consistency"))


TERMS = "t AS (SELECT lang, lower(w) AS term FROM (SELECT lang, unnest(regexp_extract_all(text, '[A-Za-z]{4,}')) AS w FROM documents)), tf AS (SELECT lang, term, count(*) AS tf FROM t GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1)"


TOKENS = "list_slice(regexp_extract_all(lower(substring({}, 1, 5000)), '[a-z]{{4,}}'), 1, 80)"


@query("cluster_tfidf_terms", HIST + f", w AS (SELECT lang, 3 AS w, unnest({TOKENS.format("array_to_string(tags, ' ')")}) AS term FROM h UNION ALL SELECT lang, 2, unnest({TOKENS.format('substring(text, 1, 60)')}) FROM h UNION ALL SELECT lang, 1, unnest({TOKENS.format('text')}) FROM h), tf AS (SELECT lang, term, sum(w) AS tf FROM w GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), n AS (SELECT count(DISTINCT lang) + 1.0 AS n FROM documents) SELECT lang, term, round(score, 6) AS score FROM (SELECT lang, term, tf * ln(n / (df + 1)) AS score, row_number() OVER (PARTITION BY lang ORDER BY tf * ln(n / (df + 1)) DESC, term) AS rn FROM tf JOIN df USING (term), n WHERE ln(n / (df + 1)) > 0) WHERE rn <= 10")
def cluster_tfidf_terms(spark, sf):
    """The most telling terms of each language, in the role of clusters: tags, first words as the subject, the text."""
    rows = history(spark, sf).select(F.col("lang").alias("cluster"), F.array_join("tags", " ").alias("tags"), F.substring("text", 1, 60).alias("subject"), "text")
    return G.cluster_terms(rows, {"tags": 3, "subject": 2, "text": 1}).select(F.col("cluster").alias("lang"), "term", six("score"))


@query("cluster_labels", HIST + """, m AS (SELECT label, doc_id, CASE WHEN label % 4 IN (1, 3) THEN NULL ELSE category END AS category, CASE WHEN label % 4 IN (2, 3) THEN [] ELSE [CASE WHEN doc_id % 2 = 0 THEN 'Even' ELSE 'odd' END, 'All', 'all', 'x' || doc_id] END AS tags FROM embeddings e JOIN h ON h.doc_id = e.vec_id), n AS (SELECT label, count(*) AS total FROM m GROUP BY 1),
 t AS (SELECT label, lower(tag) AS f, count(*) AS n, min_by(tag, doc_id * 10 + pos) AS tag FROM (SELECT label, doc_id, unnest(tags) AS tag, unnest(range(len(tags))) AS pos FROM m) GROUP BY 1, 2), r AS (SELECT label, tag, row_number() OVER (PARTITION BY label ORDER BY t.n DESC, f) AS rank FROM t JOIN n USING (label) WHERE t.n >= ceil(0.4 * total)),
 g AS (SELECT label, string_agg(tag, ' ' ORDER BY rank) FILTER (rank <= 2) AS two, string_agg(tag, ', ' ORDER BY rank) FILTER (rank <= 3) AS three FROM r GROUP BY 1), c AS (SELECT label, category, row_number() OVER (PARTITION BY label ORDER BY count(*) DESC, min(doc_id)) AS rn FROM m WHERE category IS NOT NULL GROUP BY 1, 2)
 SELECT label, CASE WHEN c.category IS NOT NULL AND two IS NOT NULL THEN two || ' ' || c.category WHEN c.category IS NOT NULL THEN c.category WHEN three IS NOT NULL THEN three ELSE 'Cluster ' || (label + 1) END AS name, CASE WHEN c.category IS NOT NULL THEN 'medium' ELSE 'low' END AS confidence FROM n LEFT JOIN g USING (label) LEFT JOIN (SELECT * FROM c WHERE rn = 1) c USING (label)""")
def cluster_labels(spark, sf):
    """Clusters of which some have no categories, some no tags, and some neither."""
    m = table(spark, sf, "embeddings").select("label", F.col("vec_id").alias("doc_id")).join(history(spark, sf).drop("tags"), "doc_id")
    tags = F.array(F.when(F.col("doc_id") % 2 == 0, "Even").otherwise("odd"), F.lit("All"), F.lit("all"), F.concat(F.lit("x"), F.col("doc_id").cast("string")))
    rows = m.select(F.col("label").alias("cluster"), F.col("doc_id").alias("id"), F.when(~(F.col("label") % 4).isin(1, 3), F.col("category")).alias("category"), F.when(~(F.col("label") % 4).isin(2, 3), tags).otherwise(F.array().cast("array<string>")).alias("tags"))
    return G.cluster_labels(rows).select(F.col("cluster").alias("label"), "name", "confidence")


@query("cluster_summary", HIST + "SELECT label, count(*) AS members, min(ts) AS first_ts, max(ts) AS last_ts, count(DISTINCT category) AS folders FROM embeddings e JOIN h ON h.doc_id = e.vec_id GROUP BY 1")
def cluster_summary(spark, sf):
    m = table(spark, sf, "embeddings").select("label", F.col("vec_id").alias("doc_id")).join(history(spark, sf), "doc_id")
    return m.groupBy("label").agg(F.count("*").alias("members"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count_distinct("category").alias("folders"))


@query("shared_terms", f"WITH {TERMS} SELECT term FROM tf WHERE lang = 'en' INTERSECT SELECT term FROM tf WHERE lang = 'fr'")
def shared_terms(spark, sf):
    t = table(spark, sf, "documents").select("lang", F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]{4,})"), 1)).alias("w")).select("lang", F.lower("w").alias("term"))
    return t.where("lang = 'en'").select("term").intersect(t.where("lang = 'fr'").select("term"))

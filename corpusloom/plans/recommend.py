"""Queries over folder suggestions, joins of catalogues, feedback and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import recommend as R
from corpusloom.operators import vectors as V
from corpusloom.operators.history import history, latest_per_key
from corpusloom.plans.history import HIST
from corpusloom.plans.registry import query
from corpusloom.session import table

CAND = HIST + """, cand AS (SELECT doc_id AS file, category AS folder, confidence / 100.0 AS score, confidence / 100.0 AS confidence, 'semantic' AS source FROM h UNION ALL SELECT doc_id, upper(category), 0.5, 0.6, 'user_pattern' FROM h WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, lang, 0.4, 0.45, 'llm' FROM h),
 g AS (SELECT file, lower(trim(folder)) AS key, min(folder) AS folder, round(max(score * CASE source WHEN 'llm' THEN 1.5 WHEN 'user_pattern' THEN 1.2 ELSE 1.1 END), 6) AS score, max(confidence) AS c, max(struct_pack(confidence := confidence, source := source)).source AS source, count(DISTINCT source) AS sources, max(CASE WHEN source = 'user_pattern' THEN 1 ELSE 0 END) AS u FROM cand GROUP BY 1, 2),
 r AS (SELECT file, folder, score, round(least(1.0, c * CASE WHEN sources > 1 THEN 1.2 ELSE 1.0 END * CASE WHEN u = 1 THEN 1.3 ELSE 1.0 END), 2) AS confidence, source, sources FROM g) """


def candidates(spark, sf):
    h = history(spark, sf)
    c = (F.col("confidence") / 100).alias("score")
    a = h.select(F.col("doc_id").alias("file"), F.col("category").alias("folder"), c, c.alias("confidence"), F.lit("semantic").alias("source"))
    b = h.where("doc_id % 3 = 0").select(F.col("doc_id").alias("file"), F.upper("category").alias("folder"), F.lit(0.5).alias("score"), F.lit(0.6).alias("confidence"), F.lit("user_pattern").alias("source"))
    return a.unionByName(b).unionByName(h.select(F.col("doc_id").alias("file"), F.col("lang").alias("folder"), F.lit(0.4).alias("score"), F.lit(0.45).alias("confidence"), F.lit("llm").alias("source")))


@query("combine_sources", CAND + "SELECT source, count(*) AS n FROM cand GROUP BY 1")
def combine_sources(spark, sf):
    return candidates(spark, sf).groupBy("source").agg(F.count("*").alias("n"))


@query("rank_suggestions", CAND + "SELECT file, folder, score, source, row_number() OVER (PARTITION BY file ORDER BY score DESC, confidence DESC, folder) AS rank FROM r")
def rank_suggestions(spark, sf):
    return R.ranked(candidates(spark, sf)).select("file", "folder", "score", "source", F.col("rank").cast("long").alias("rank"))


@query("suggestion_confidence", CAND + "SELECT file, folder, confidence, sources FROM r")
def suggestion_confidence(spark, sf):
    return R.ranked(candidates(spark, sf)).select("file", "folder", "confidence", "sources")


@query("cluster_boost", CAND + "SELECT file, folder, round(score * CASE WHEN e.label % 2 = 0 THEN 1.3 ELSE 1.0 END, 5) AS score FROM r LEFT JOIN embeddings e ON e.vec_id = file")
def cluster_boost(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("file"), "label")
    return R.ranked(candidates(spark, sf)).join(e, "file", "left").select("file", "folder", F.round(F.col("score") * F.when(F.col("label") % 2 == 0, 1.3).otherwise(1.0), 5).alias("score"))


@query("memory_adjustment", CAND + """, m AS (SELECT ext, max_by(folder, ts) AS rule FROM (SELECT ext, category AS folder, ts FROM h) GROUP BY 1), k AS (SELECT doc_id AS file, category AS known, least(0.15, 0.15 * confidence / 101.0) AS b FROM h WHERE doc_id % 2 = 0)
 SELECT file, r.folder, round(greatest(0.0, least(1.0, score + CASE WHEN lower(r.folder) = lower(m.rule) THEN 0.2 ELSE -0.1 END + CASE WHEN b IS NULL THEN 0 WHEN lower(r.folder) = lower(known) THEN b ELSE -b END)), 5) AS score FROM r JOIN h ON h.doc_id = file JOIN m USING (ext) LEFT JOIN k USING (file)""")
def memory_adjustment(spark, sf):
    """The newest file of an extension says its rule; every second file is like one that is remembered in its own category."""
    h = history(spark, sf)
    rules = h.groupBy("ext").agg(F.max_by("category", "ts").alias("folder"))
    known = h.where("doc_id % 2 = 0").select(F.col("doc_id").alias("file"), F.col("category").alias("folder"), (F.col("confidence") / 101.0).alias("score"))
    r = R.ranked(candidates(spark, sf)).join(h.select(F.col("doc_id").alias("file"), "ext"), "file").select("file", "folder", "ext", "score")
    return R.adjusted_by_memory(r, rules, known).select("file", "folder", F.round("score", 5).alias("score"))


@query("latest_rule", HIST + "SELECT ext, max_by(category, ts) AS folder, max(ts) AS ts FROM h GROUP BY 1")
def latest_rule(spark, sf):
    return history(spark, sf).groupBy("ext").agg(F.max_by("category", "ts").alias("folder"), F.max("ts").alias("ts"))


@query("unresolved_penalty", CAND + "SELECT file, folder, CASE WHEN lower(folder) LIKE 'src%' THEN score ELSE least(0.2, score) END AS score FROM r")
def unresolved_penalty(spark, sf):
    known = table(spark, sf, "documents").select(F.col("source").alias("folder")).distinct()
    return R.penalised(R.ranked(candidates(spark, sf)), known).select("file", "folder", "score")


@query("move_detection", """WITH f AS (SELECT event_id, event_type, epoch_us(ts) / 1e6 AS s, json_extract(props, '$.k')::BIGINT AS size, CASE user_id % 2 WHEN 0 THEN '.txt' ELSE '.pdf' END AS ext, 'f' || (user_id % 10) AS base FROM events),
 p AS (SELECT d.event_id AS deleted, a.event_id AS added, d.base = a.base AS named FROM f d JOIN f a ON d.size = a.size AND d.ext = a.ext AND abs(d.s - a.s) <= 7200 WHERE d.event_type = 'error' AND a.event_type = 'signup'),
 g AS (SELECT added, count(*) AS n, min(deleted) AS one, count(*) FILTER (named) AS nn, min(deleted) FILTER (named) AS namesake FROM p GROUP BY 1) SELECT CASE WHEN n = 1 THEN one WHEN nn = 1 THEN namesake END AS deleted, added FROM g WHERE n = 1 OR nn = 1""")
def move_detection(spark, sf):
    """Errors stand for deletes and sign-ups for adds; props hold a size, users the name."""
    path = F.concat(F.lit("/d/F"), (F.col("user_id") % 10).cast("string"), F.when(F.col("user_id") % 2 == 0, ".txt").otherwise(".PDF"))
    f = table(spark, sf, "events").select(F.col("event_id").alias("id"), "event_type", path.alias("path"), F.from_json("props", "k long")["k"].alias("size"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("s"))
    return R.moves(f.where("event_type = 'error'"), f.where("event_type = 'signup'"), tolerance_s=7200.0)


@query("pattern_match_top3", "WITH f AS (SELECT p_partkey AS file, string_split(p_name, ' ') AS a FROM part), pt AS (SELECT p_name AS pattern, string_split(p_name, ' ') AS b, least(1.0, 0.5 + 0.01 * count(*)) AS confidence FROM part GROUP BY 1), s AS (SELECT file, pattern, (CASE WHEN a[1] = b[1] THEN 1 ELSE 0 END + CASE WHEN a[2] = b[2] THEN 1 ELSE 0 END) / 2.0 AS similarity, confidence FROM f, pt WHERE a[1] = b[1] OR a[2] = b[2]), r AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY round(similarity * confidence, 9) DESC, pattern) AS rank FROM s) SELECT file, pattern, similarity, round(similarity * confidence, 6) AS score, rank FROM r WHERE rank <= 3")
def pattern_match_top3(spark, sf):
    """Names of two words are the paths; the more often a name occurs, the surer it is as a pattern."""
    p = table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("pattern"), F.split("p_name", " ").alias("parts"))
    known = p.groupBy("pattern", "parts").agg(F.least(F.lit(1.0), 0.5 + 0.01 * F.count("*")).alias("confidence"))
    hits = R.match_patterns(p.select(F.col("p_partkey").alias("file"), "parts"), known)
    return hits.select("file", "pattern", "similarity", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("folder_match_cascade", "WITH w AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN CAST(c_nationkey AS VARCHAR) WHEN 1 THEN n_name ELSE lower(n_name) END AS wanted FROM customer JOIN nation ON c_nationkey = n_nationkey) SELECT c_custkey, coalesce((SELECT n_nationkey FROM nation WHERE CAST(n_nationkey AS VARCHAR) = wanted), (SELECT n_nationkey FROM nation WHERE n_name = wanted), (SELECT n_nationkey FROM nation WHERE lower(n_name) = lower(wanted))) AS folder FROM w")
def folder_match_cascade(spark, sf):
    n = table(spark, sf, "nation")
    w = table(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.col("c_nationkey").cast("string")).when(F.col("c_custkey") % 3 == 1, F.col("n_name")).otherwise(F.lower("n_name")).alias("wanted"))
    by = lambda key, name: n.select(key.alias("wanted" if name != "low" else "lw"), F.col("n_nationkey").alias(name))
    j = w.join(by(F.col("n_nationkey").cast("string"), "id"), "wanted", "left").join(by(F.col("n_name"), "path"), "wanted", "left").join(by(F.lower("n_name"), "low"), F.lower("wanted") == F.col("lw"), "left")
    return j.select("c_custkey", F.coalesce("id", "path", "low").alias("folder"))


PAIRS = "w AS (SELECT DISTINCT p_type, string_split(p_type, ' ') AS w FROM part), o AS (SELECT a.p_type AS a, b.p_type AS b, len(list_intersect(list_distinct(a.w), list_distinct(b.w))) * 1.0 / greatest(len(list_distinct(a.w)), len(list_distinct(b.w))) AS score FROM w a, w b WHERE a.p_type < b.p_type AND list_has_any(a.w, b.w))"


@query("folder_overlaps", """WITH f AS (SELECT DISTINCT p_name AS folder, string_split(p_name, ' ') AS name, [string_split(p_name, ' ')[1], 'made'] AS words, [string_split(p_name, ' ')[2]] AS tags FROM part),
 s AS (SELECT a.folder AS a, b.folder AS b, 0.4 * len(list_intersect(list_distinct(a.name), list_distinct(b.name))) / greatest(len(list_distinct(a.name)), len(list_distinct(b.name))) + 0.3 * len(list_intersect(a.words, b.words)) / 2 + 0.3 * len(list_intersect(a.tags, b.tags)) AS score FROM f a, f b WHERE a.folder < b.folder)
 SELECT a, b, round(score, 6) AS score FROM s WHERE round(score, 6) > 0.3 ORDER BY 3 DESC, 1, 2 LIMIT 100""")
def folder_overlaps(spark, sf):
    t = F.split("p_name", " ")
    f = table(spark, sf, "part").select(F.col("p_name").alias("folder"), t.alias("name"), F.array(t[0], F.lit("made")).alias("words"), F.array(t[1]).alias("tags"))
    return R.overlapping_folders(f, 0.3)


STRATEGIES = {"project": (["category"], "Projects/{project}/src3"), "type": (["tag", "lang"], "Types/{type}")}


@query("strategy_scores", HIST + "SELECT doc_id, least(1.0, 0.3 + CASE WHEN list_has_any(string_split(trim(regexp_replace(lower(category || ' ' || file_name), '[^a-z0-9]+', ' ', 'g')), ' '), ['projects', 'src3']) THEN 0.4 ELSE 0 END) AS project, least(1.0, CASE WHEN doc_id % 4 = 0 THEN 0 ELSE 0.3 END + 0.3) AS type FROM h")
def strategy_scores(spark, sf):
    h = strategy_files(spark, sf)
    one = lambda k: R.strategy_score([F.col(c) for c in STRATEGIES[k][0]], F.col("name"), STRATEGIES[k][1]).alias(k)
    return h.select("doc_id", one("project"), one("type"))


def strategy_files(spark, sf):
    h = history(spark, sf)
    return h.select("doc_id", "category", "lang", F.concat_ws(" ", "category", "file_name").alias("name"), F.when(F.col("doc_id") % 4 != 0, F.element_at("tags", -1)).alias("tag"), "ext")


@query("best_strategy", HIST + ", s AS (SELECT category, avg(least(1.0, 0.3 + CASE WHEN list_has_any(string_split(trim(regexp_replace(lower(category || ' ' || file_name), '[^a-z0-9]+', ' ', 'g')), ' '), ['projects', 'src3']) THEN 0.4 ELSE 0 END)) AS p, avg(CASE WHEN doc_id % 4 = 0 THEN 0 ELSE 0.3 END + 0.3) AS t, count(*) AS n FROM h GROUP BY 1) SELECT category, CASE WHEN greatest(round(p, 9), round(t, 9)) <= 0.3 THEN 'adaptive' WHEN round(p, 9) >= round(t, 9) THEN 'project' ELSE 'type' END AS strategy, CASE WHEN greatest(round(p, 9), round(t, 9)) <= 0.3 THEN round(0.75 + least(0.15, 0.005 * n), 6) ELSE round(greatest(p, t), 6) END AS score FROM s")
def best_strategy(spark, sf):
    return R.best_strategy(strategy_files(spark, sf), "category", STRATEGIES).select("category", "strategy", F.round("score", 6).alias("score"))


@query("parse_rules", "SELECT n_nationkey, lower(regexp_extract(t, '(?i)^(\\w+) files go to ([\\w ]+)$', 1)) AS extension, regexp_extract(t, '(?i)^(\\w+) files go to ([\\w ]+)$', 2) AS folder FROM (SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'PDF files go to ' || n_name ELSE 'nothing here' END AS t FROM nation)")
def parse_rules(spark, sf):
    t = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("PDF files go to "), "n_name")).otherwise("nothing here")
    part = lambda k: F.regexp_extract(t, r"(?i)^(\w+) files go to ([\w ]+)$", k)
    return table(spark, sf, "nation").select("n_nationkey", F.lower(part(1)).alias("extension"), part(2).alias("folder"))


def feedback(spark, sf):
    return table(spark, sf, "events").where("event_type IN ('click', 'error')").select(F.concat_ws(":", "event_type", (F.col("user_id") % 20).cast("string")).alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("id"), (F.col("event_id") % 3 != 0).alias("accepted"))


@query("pattern_learning", """WITH RECURSIVE e AS (SELECT event_type || ':' || (user_id % 20) AS key, event_id % 3 <> 0 AS ok, row_number() OVER (PARTITION BY event_type, user_id % 20 ORDER BY ts, event_id) AS k FROM events WHERE event_type IN ('click', 'error')),
 f AS (SELECT key, k, CAST(CASE WHEN ok THEN 1 ELSE 0 END AS BIGINT) AS count, CASE WHEN ok THEN CAST(0.5 AS DOUBLE) END AS conf FROM e WHERE k = 1 UNION ALL
 SELECT e.key, e.k, CASE WHEN ok THEN count + 1 WHEN conf - CAST(0.15 AS DOUBLE) < CAST(0.1 AS DOUBLE) THEN 0 ELSE count END, CASE WHEN ok THEN CASE WHEN conf IS NULL THEN CAST(0.5 AS DOUBLE) ELSE least(CAST(1 AS DOUBLE), conf + CAST(0.1 AS DOUBLE)) END WHEN conf - CAST(0.15 AS DOUBLE) >= CAST(0.1 AS DOUBLE) THEN conf - CAST(0.15 AS DOUBLE) END FROM f JOIN e ON e.key = f.key AND e.k = f.k + 1)
 SELECT key, count, round(coalesce(conf, 0), 4) AS confidence, conf IS NOT NULL AS alive FROM f WHERE (key, k) IN (SELECT (key, max(k)) FROM e GROUP BY key)""")
def pattern_learning(spark, sf):
    return R.learned_patterns(feedback(spark, sf))


@query("pattern_prune", """WITH p AS (SELECT user_id AS key, count(*) AS n, max(epoch_us(ts)) / 1e6 AS last, 0.1 * (1 + user_id % 9) AS confidence FROM events WHERE event_type = 'error' GROUP BY 1), m AS (SELECT max(last) AS now FROM p), s AS (SELECT key, now - last AS age, round(n * confidence / (1 + (now - last) / 2592000.0), 9) AS score FROM p, m)
 SELECT key, 'stale' AS reason FROM s WHERE age > 86400 UNION ALL SELECT key, 'low' FROM (SELECT key, row_number() OVER (ORDER BY score, key) AS rn, count(*) OVER () AS left_over FROM s WHERE age <= 86400) WHERE rn <= 4 AND left_over >= 40""")
def pattern_prune(spark, sf):
    """Users' errors are patterns; a day old they are stale, and of forty or more that are left the four lowest go."""
    p = table(spark, sf, "events").where("event_type = 'error'").groupBy(F.col("user_id").alias("key")).agg(F.count("*").alias("count"), F.max(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("last"))
    p = p.withColumn("confidence", 0.1 * (1 + F.col("key") % 9))
    now = p.agg(F.max("last")).first()[0] or 0.0
    return R.pruned_patterns(p, now, capacity=40, stale_s=86_400.0)


@query("feedback_retention", "SELECT event_id FROM (SELECT event_id, ts FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 10 DAY ORDER BY ts DESC, event_id DESC LIMIT 1000)")
def feedback_retention(spark, sf):
    e = table(spark, sf, "events").select("event_id", "ts")
    newest = e.select(F.max("ts")).scalar()
    return e.where(F.col("ts") >= newest - F.expr("INTERVAL 10 DAYS")).orderBy(F.desc("ts"), F.desc("event_id")).limit(1000).select("event_id")


@query("feedback_weights", "SELECT event_type, round(CAST(sum(CASE event_type WHEN 'click' THEN 1.0 WHEN 'view' THEN 1.0 WHEN 'purchase' THEN 0.9 WHEN 'signup' THEN 0.6 ELSE 0.4 END * 0.85) AS DOUBLE), 4) AS weight FROM events GROUP BY 1")
def feedback_weights(spark, sf):
    weight = F.lit(0.4)
    for name, w in (("click", 1.0), ("view", 1.0), ("purchase", 0.9), ("signup", 0.6)):
        weight = F.when(F.col("event_type") == name, w).otherwise(weight)
    return table(spark, sf, "events").groupBy("event_type").agg(F.round(F.sum(weight * 0.85), 4).alias("weight"))


@query("folder_fit", "WITH w AS (SELECT p_partkey, list_distinct(string_split(lower(p_name), ' ')) AS a, list_distinct(string_split(lower(p_type), ' ')) AS b, p_brand FROM part) SELECT p_partkey, round(0.6 * len(list_intersect(a, b)) / greatest(len(a), len(b)) + 0.2 * len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS fit FROM w")
def folder_fit(spark, sf):
    a, b = F.split(F.lower("p_name"), " "), F.split(F.lower("p_type"), " ")
    return table(spark, sf, "part").select("p_partkey", F.round(R.folder_fit(a, b, a, b, F.col("p_brand"), a, b), 6).alias("fit"))


@query("missing_categories", "SELECT c AS category FROM (SELECT unnest(['Standard', 'small', 'Promo', 'Invoices', 'Large']) AS c) WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_size % 2 = 1 AND p_type NOT IN ('PROMO', 'LARGE') AND contains(lower(p_type), lower(c))) AND EXISTS (SELECT 1 FROM part WHERE contains(lower(p_type), lower(c)))")
def missing_categories(spark, sf):
    p = table(spark, sf, "part")
    return R.missing_categories(p.select(F.col("p_type").alias("category")), p.where("p_size % 2 = 1 AND p_type NOT IN ('PROMO', 'LARGE')").select(F.col("p_type").alias("folder")), ["Standard", "small", "Promo", "Invoices", "Large"])


NEAREST = "WITH c AS (SELECT label, list(x ORDER BY pos) AS centroid FROM (SELECT label, pos, avg(CAST(embedding[pos] AS DOUBLE)) AS x FROM embeddings, (SELECT unnest(generate_series(1, 64)) AS pos) GROUP BY 1, 2) GROUP BY 1), n AS (SELECT vec_id AS doc_id, label AS folder, s AS cosine FROM (SELECT vec_id, c.label, list_cosine_similarity(CAST(embedding AS DOUBLE[]), centroid) AS s, row_number() OVER (PARTITION BY vec_id ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), centroid) DESC, c.label) AS rn FROM embeddings, c) WHERE rn = 1)"


def nearest_folder(spark, sf):
    e = table(spark, sf, "embeddings")
    centres = V.centroids(e, "label").select(F.col("label").cast("long").alias("folder"), F.col("centroid").alias("embedding"))
    return V.best_folders(e, centres, 1).select(F.col("vec_id").alias("doc_id"), F.col("folder").cast("string").alias("folder"), F.col("score").alias("cosine"))


@query("category_override", NEAREST + HIST.replace("WITH h AS", ", h AS", 1) + "SELECT h.doc_id, CASE WHEN cosine >= 0.3 AND cosine > CASE WHEN ext = 'txt' THEN 0 ELSE confidence / 100.0 END THEN CAST(folder AS VARCHAR) ELSE CASE WHEN ext = 'txt' THEN 'Unknown' ELSE category END END AS category FROM h LEFT JOIN n ON n.doc_id = h.doc_id")
def category_override(spark, sf):
    """The model's category is unknown for one extension; the nearest cluster's mean is the nearest folder."""
    h = history(spark, sf).join(nearest_folder(spark, sf), "doc_id", "left")
    own = F.when(F.col("ext") == "txt", "Unknown").otherwise(F.col("category"))
    return h.select("doc_id", R.category_override(own, F.col("confidence") / 100, F.col("folder"), F.col("cosine"), least=0.3).alias("category"))


@query("auto_organize_decision", HIST + ", k AS (SELECT source AS folder FROM documents GROUP BY 1 HAVING count(*) >= 10) SELECT doc_id, CASE WHEN ext = 'csv' THEN 'review' WHEN confidence >= 75 AND EXISTS (SELECT 1 FROM k WHERE folder = category) THEN 'organise' WHEN confidence >= 75 THEN 'review' WHEN lang <> 'es' THEN 'low-confidence-default' ELSE 'review' END AS decision FROM h")
def auto_organize_decision(spark, sf):
    """Folders with ten files or more are known; tables have no suggestion, Spanish files no default folder."""
    known = table(spark, sf, "documents").groupBy(F.col("source").alias("category")).agg(F.count("*").alias("n")).where("n >= 10").select("category", F.lit(True).alias("known"))
    h = history(spark, sf).join(known, "category", "left")
    d = R.organise_decision(F.when(F.col("ext") != "csv", F.col("category")), F.col("confidence") / 100, F.coalesce("known", F.lit(False)), default_folder=F.when(F.col("lang") != "es", "Inbox"))
    return h.select("doc_id", d.alias("decision"))


@query("batch_recommendations", HIST + ", g AS (SELECT category, count(DISTINCT lang) AS langs, max(ts) - min(ts) AS span, count(DISTINCT doc_id % 9) AS n, max(CASE WHEN doc_id % 40 = 7 THEN 1 ELSE 0 END) AS work FROM h GROUP BY 1) SELECT category, 'project' AS kind, 0.9 AS confidence FROM g WHERE langs = 1 UNION ALL SELECT category, 'temporal', 0.7 FROM g WHERE span < 86400 * 400 UNION ALL SELECT category, 'workflow', 0.8 FROM g WHERE work = 1 UNION ALL SELECT category, 'groups', 0.6 FROM g WHERE n > 5")
def batch_recommendations(spark, sf):
    """A category is a batch; its languages stand for projects, and some of its files are drafts."""
    h = history(spark, sf)
    one = F.when(F.count_distinct("lang") == 1, F.min("lang"))
    g = h.groupBy(F.col("category").alias("group")).agg(one.alias("project"), (F.max("ts") - F.min("ts") < 86400 * 400).alias("has_dates"), F.collect_set(F.when(F.col("doc_id") % 40 == 7, F.lit("Draft")).otherwise(F.lit("plain"))).alias("terms"), F.count_distinct(F.col("doc_id") % 9).alias("folders"))
    return R.batch_recommendations(g).withColumnRenamed("group", "category")


@query("cluster_batch", HIST + ", b AS (SELECT doc_id, e.label AS cluster FROM h LEFT JOIN embeddings e ON e.vec_id = doc_id WHERE doc_id % 3 = 0), m AS (SELECT e.label AS cluster, d.source AS folder, row_number() OVER (PARTITION BY e.label ORDER BY count(*) DESC, d.source) AS rn FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id GROUP BY 1, 2) SELECT doc_id AS file, b.cluster, m.folder, CASE WHEN m.folder IS NOT NULL THEN 0.85 END AS score, count(*) OVER (PARTITION BY b.cluster) AS n FROM b LEFT JOIN m ON m.cluster = b.cluster AND rn = 1")
def cluster_batch(spark, sf):
    """Every third file is the batch; a cluster's folder is where most of its files lie."""
    members = table(spark, sf, "embeddings").select(F.col("vec_id").alias("file"), F.col("label").alias("cluster"))
    lies = members.join(table(spark, sf, "documents").select(F.col("doc_id").alias("file"), "source"), "file").groupBy("cluster", "source").agg(F.count("*").alias("n"))
    named = latest_per_key(lies, "cluster", F.desc("n"), F.asc("source")).select("cluster", F.col("source").alias("folder"), F.lit(0.85).alias("score"))
    return R.cluster_batches(history(spark, sf).where("doc_id % 3 = 0").select(F.col("doc_id").alias("file")), members, named)


@query("rule_category", HIST + "SELECT doc_id, CASE WHEN a > 0 AND a >= b THEN 'Projects' WHEN b > 0 THEN 'Reports' WHEN ext = 'csv' THEN 'Tables' WHEN ext = 'png' THEN 'Pictures' ELSE 'Documents' END AS category FROM (SELECT doc_id, ext, CASE WHEN contains(file_name, 'doc1') THEN 4 ELSE 0 END + CASE WHEN contains(file_name, '77') THEN 2 ELSE 0 END AS a, CASE WHEN contains(file_name, '42.pdf') THEN 6 ELSE 0 END + CASE WHEN contains(file_name, '99') THEN 2 ELSE 0 END AS b FROM h)")
def rule_category(spark, sf):
    keywords = {"Projects": ["Doc1", "77"], "Reports": ["42.pdf", "99"]}
    return history(spark, sf).select("doc_id", R.rule_category(F.col("file_name"), F.col("ext"), keywords, {"csv": "Tables", "png": "Pictures"}).alias("category"))


#: Parts in the role of files and of folders: folders are first words of names, with what the parts of one have in common.
PARTS = "fi AS (SELECT p_partkey AS file, replace(p_name, ' ', '_') || '-' || lower(p_type) || '.' || CASE p_partkey % 3 WHEN 0 THEN 'pdf' WHEN 1 THEN 'csv' ELSE 'txt' END AS name FROM part), fo AS (SELECT string_split(p_name, ' ')[1] AS folder, 'things like ' || min(string_split(p_name, ' ')[2]) || ', also .' || CASE WHEN min(p_size) % 2 = 0 THEN 'pdf' ELSE 'csv' END AS description, [min(string_split(p_name, ' ')[2]), 'txt'] AS tags, [max(lower(p_type)), '.pdf'] AS keywords, '/' || min(p_type) || '/' || max(string_split(p_name, ' ')[2]) AS path, max(p_type) || ' goods' AS category, [max(string_split(p_name, ' ')[1])] AS related, max(p_size) / 51.0 AS confidence FROM part GROUP BY 1)"


@query("folder_scores", f"""WITH {PARTS}, x AS (SELECT file, name, folder, string_split(name, '.')[-1] AS ext, fo.* EXCLUDE (folder) FROM fi, fo),
 s AS (SELECT file, folder, (CASE WHEN contains(name, folder) THEN 10 ELSE 0 END + 8 * len(list_filter(string_split_regex(folder, '[\\s_-]+'), lambda w: length(w) > 2 AND contains(name, w))) + 6 * len(list_filter(string_split_regex(description, '[\\s,.-]+'), lambda w: length(w) > 3 AND contains(name, w)))
 + CASE WHEN contains(description, ext) THEN 15 ELSE 0 END + 5 * len(list_filter(tags, lambda w: contains(name, w))) + 10 * len(list_filter(tags, lambda w: w = ext OR w = '.' || ext)) + 4 * len(list_filter(keywords, lambda w: contains(name, w))) + 12 * len(list_filter(keywords, lambda w: w = ext OR w = '.' || ext))
 + 3 * len(list_filter(string_split(lower(path), '/'), lambda w: length(w) > 2 AND contains(name, w))) + 2 * len(list_filter(string_split_regex(lower(category), '[\\s_-]+'), lambda w: length(w) > 2 AND contains(name, w))) + len(list_filter(related, lambda w: contains(name, w)))) * CASE WHEN confidence > 0.8 THEN 1.2 ELSE 1.0 END AS score FROM x)
 SELECT file, folder, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY round(score, 6) DESC, folder) AS rn FROM s WHERE score >= 5) WHERE rn = 1""")
def folder_scores(spark, sf):
    p = table(spark, sf, "part").withColumn("w", F.split("p_name", " "))
    kind = F.element_at(F.array(F.lit("pdf"), F.lit("csv"), F.lit("txt")), (F.col("p_partkey") % 3 + 1).cast("int"))
    files = p.select(F.col("p_partkey").alias("file"), F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("-"), F.lower("p_type"), F.lit("."), kind).alias("name"))
    second = F.col("w")[1]
    folders = p.groupBy(F.col("w")[0].alias("folder")).agg(
        F.concat(F.lit("things like "), F.min(second), F.lit(", also ."), F.when(F.min("p_size") % 2 == 0, "pdf").otherwise("csv")).alias("description"), F.array(F.min(second), F.lit("txt")).alias("tags"),
        F.array(F.max(F.lower("p_type")), F.lit(".pdf")).alias("keywords"), F.concat(F.lit("/"), F.min("p_type"), F.lit("/"), F.max(second)).alias("path"), F.concat(F.max("p_type"), F.lit(" goods")).alias("category"), F.array(F.max(F.col("w")[0])).alias("related"), (F.max("p_size") / 51.0).alias("confidence"),
    )
    return R.score_folders(files, folders).select("file", "folder", F.round("score", 6).alias("score"))


@query("rule_keywords", HIST + "SELECT doc_id, list_slice(list_filter(['' || replace(category, '_', ' '), 'doc' || doc_id, 'tag' || (doc_id % 7)], lambda w: length(w) > 2), 1, 10) AS keywords FROM h")
def rule_keywords(spark, sf):
    h = history(spark, sf)
    return h.select("doc_id", R.rule_keywords(F.col("category"), F.col("file_name"), F.slice("tags", 2, 1)).alias("keywords"))


@query("category_to_folder", """WITH w AS (SELECT DISTINCT substring(p_type, 1 + length(p_type) % 3) AS category FROM part UNION SELECT 'Misc' UNION SELECT 'Promo  Burnished-Tin' UNION SELECT 'brushed things of steel'), f AS (SELECT DISTINCT p_type AS folder FROM part WHERE p_partkey % 3 = 0),
 p AS (SELECT category, folder, trim(regexp_replace(lower(category), '[^a-z0-9]+', ' ', 'g')) AS x, trim(regexp_replace(lower(folder), '[^a-z0-9]+', ' ', 'g')) AS y FROM w, f),
 q AS (SELECT category, folder, x, y, levenshtein(x, y) AS d, list_distinct(string_split(x, ' ')) AS a, list_distinct(string_split(y, ' ')) AS b FROM p),
 r AS (SELECT category, folder, CASE WHEN category = folder THEN 1 WHEN x = y THEN 2 WHEN d <= CASE WHEN length(x) > 10 THEN 3 ELSE 2 END THEN 3 ELSE 4 END AS step, CASE WHEN category = folder OR x = y THEN 0.0 WHEN d <= CASE WHEN length(x) > 10 THEN 3 ELSE 2 END THEN d ELSE -(len(list_intersect(a, b)) * 1.0 / greatest(len(a), len(b)) - least(0.25, 0.01 * (greatest(len(a), len(b)) - len(list_intersect(a, b))))) END AS cost FROM q),
 b AS (SELECT category, folder, step, row_number() OVER (PARTITION BY category ORDER BY step, round(cost, 9), folder) AS rn FROM r WHERE step < 4 OR cost < -0.5) SELECT category, CASE WHEN category = 'Misc' THEN 'Uncategorized' ELSE coalesce(folder, 'Uncategorized') END AS folder, CAST(CASE WHEN category = 'Misc' THEN 0 ELSE coalesce(step, 0) END AS INTEGER) AS step FROM w LEFT JOIN (SELECT * FROM b WHERE rn = 1) USING (category)""")
def category_to_folder(spark, sf):
    """Types with their first letters cut off, against a third of the types as folders."""
    p = table(spark, sf, "part")
    extra = spark.createDataFrame([("Misc",), ("Promo  Burnished-Tin",), ("brushed things of steel",)], "category string")
    cut = F.col("p_type").substr(1 + F.length("p_type") % 3, F.length("p_type"))
    return R.match_categories(p.select(cut.alias("category")).unionByName(extra), p.where("p_partkey % 3 = 0").select(F.col("p_type").alias("folder")))


@query("model_category_suggestion", HIST + "SELECT doc_id, coalesce(nullif(CASE WHEN doc_id % 2 = 0 THEN category ELSE '' END, ''), lang) AS folder, CASE WHEN doc_id % 2 = 0 THEN greatest(c, 0.95) WHEN levenshtein(lang, lower(category)) <= 3 THEN greatest(c, 0.95) ELSE c END AS score FROM (SELECT *, CASE WHEN doc_id % 5 = 4 THEN 0.6 WHEN confidence > 1 THEN confidence / 100.0 ELSE confidence END AS c FROM h)")
def model_category_suggestion(spark, sf):
    given = F.when(F.col("doc_id") % 2 == 0, F.col("category")).otherwise(" ")
    s = R.model_suggestion([given, F.col("lang")], F.when(F.col("doc_id") % 5 != 4, F.col("confidence")), F.col("category"))
    return history(spark, sf).select("doc_id", s["given"].alias("folder"), s["score"].alias("score"))


@query("improvement_suggestions", "WITH w AS (SELECT p_partkey, list_distinct(string_split(lower(p_name), ' ')) AS a, list_distinct(string_split(lower(p_type), ' ')) AS b FROM part), f AS (SELECT p_partkey, round(0.6 * len(list_intersect(a, b)) / greatest(len(a), len(b)) + 0.2 * len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS fit FROM w) SELECT p_partkey, CASE WHEN fit > 0.3 AND fit < 0.7 THEN round(fit + 0.2, 6) ELSE 0.6 END AS score, NOT (fit > 0.3 AND fit < 0.7) AS new_folder FROM f")
def improvement_suggestions(spark, sf):
    f = folder_fit(spark, sf)
    some = (F.col("fit") > 0.3) & (F.col("fit") < 0.7)
    return f.select("p_partkey", F.when(some, F.round(F.col("fit") + 0.2, 6)).otherwise(0.6).alias("score"), (~some).alias("new_folder"))


@query("cluster_folder", """WITH c AS (SELECT DISTINCT p_partkey AS cluster, p_name AS label, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS x FROM part WHERE p_partkey % 5 = 0), f AS (SELECT DISTINCT p_type AS folder, trim(regexp_replace(lower(p_type), '[^a-z0-9]+', ' ', 'g')) AS y FROM part UNION SELECT DISTINCT p_name, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) FROM part WHERE p_partkey % 7 = 0),
 s AS (SELECT cluster, label, folder, CASE WHEN x = y OR contains(x, y) OR contains(y, x) THEN 0.85 ELSE 0.8 * len(list_intersect(list_distinct(string_split(x, ' ')), list_distinct(string_split(y, ' ')))) / greatest(len(list_distinct(string_split(x, ' '))), len(list_distinct(string_split(y, ' ')))) END AS score FROM c, f),
 b AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY round(score, 9) DESC, folder) AS rn FROM s WHERE score > 0.24 + 1e-9)
 SELECT c.cluster, coalesce(folder, c.label) AS folder, round(coalesce(score, 0.6), 6) AS score, folder IS NULL AS new FROM c LEFT JOIN (SELECT * FROM b WHERE rn = 1) b ON b.cluster = c.cluster""")
def cluster_folder(spark, sf):
    p = table(spark, sf, "part")
    folders = p.select(F.col("p_type").alias("folder")).unionByName(p.where("p_partkey % 7 = 0").select(F.col("p_name").alias("folder")))
    out = R.cluster_folders(p.where("p_partkey % 5 = 0").select(F.col("p_partkey").alias("cluster"), F.col("p_name").alias("label")), folders)
    return out.select("cluster", "folder", F.round("score", 6).alias("score"), "new")


@query("folder_word_overlap", "SELECT item_id, n_name, len(list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z]+')), lambda w: contains(lower(n_name), w))) AS hits FROM benchmark, nation WHERE len(list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z]+')), lambda w: contains(lower(n_name), w))) > 0")
def folder_word_overlap(spark, sf):
    """Folder names are few: each becomes the list of its own parts, met by the words of the texts."""
    w = table(spark, sf, "benchmark").select("item_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), 1))).alias("w"))
    n = table(spark, sf, "nation").select("n_name", F.lower("n_name").alias("l"))
    cuts = F.flatten(F.transform(F.sequence(F.lit(1), F.length("l")), lambda i: F.transform(F.sequence(F.lit(1), F.length("l") - i + 1), lambda k: F.col("l").substr(i, k))))
    parts = n.select("n_name", F.explode(F.array_distinct(cuts)).alias("w"))
    return w.join(parts, "w").groupBy("item_id", "n_name").agg(F.count("*").alias("hits"))


@query("unique_names", """WITH e AS (SELECT CAST(user_id % 40 AS VARCHAR) AS dir, event_id, CASE WHEN event_id % 3 = 0 THEN upper(event_type) ELSE event_type END || CASE WHEN event_id % 25 = 0 THEN '-' || (2 + event_id % 7) ELSE '' END || '.txt' AS name FROM events),
 n AS (SELECT *, row_number() OVER (PARTITION BY dir, lower(name) ORDER BY event_id) AS m, name[: length(name) - 4] AS stem FROM e), u AS (SELECT DISTINCT dir, lower(name) AS used FROM e),
 c AS (SELECT dir, lower(stem) AS l, unnest(range(2, max(m) + 20)) AS i FROM n GROUP BY 1, 2), x AS (SELECT c.dir, l, i, row_number() OVER (PARTITION BY c.dir, l ORDER BY i) + 1 AS m FROM c LEFT JOIN u ON u.dir = c.dir AND u.used = l || '-' || i || '.txt' WHERE u.used IS NULL)
 SELECT n.dir, event_id, CASE WHEN n.m = 1 THEN name ELSE stem || '-' || i || '.txt' END AS unique_name FROM n LEFT JOIN x ON x.dir = n.dir AND x.l = lower(stem) AND x.m = n.m""")
def unique_names(spark, sf):
    """Users share forty folders; every 25th file is named as if it were a repetition already."""
    kind = F.when(F.col("event_id") % 3 == 0, F.upper("event_type")).otherwise(F.col("event_type"))
    number = F.when(F.col("event_id") % 25 == 0, F.concat(F.lit("-"), (2 + F.col("event_id") % 7).cast("string"))).otherwise("")
    e = table(spark, sf, "events").select((F.col("user_id") % 40).cast("string").alias("dir"), F.concat(kind, number, F.lit(".txt")).alias("name"), "event_id")
    return R.unique_names(e, dir_col="dir", name_col="name", order_col="event_id")


@query("folder_cascade", NEAREST + """, f AS (SELECT doc_id AS file, list_distinct(list_transform(string_split_regex(text, '[^A-Za-z]+'), lambda w: lower(w))) AS words FROM documents), d AS (SELECT n_name AS folder, unnest(list_distinct(string_split_regex(lower(n_name || ' of the land that was'), '\\W+'))) AS w FROM nation),
 v AS (SELECT doc_id AS file, folder, cosine FROM n WHERE cosine >= 0.3), m AS (SELECT doc_id AS file, lang AS folder, 0.5 AS score FROM documents WHERE doc_id % 3 = 0),
 h AS (SELECT file, folder, count(*) AS c, row_number() OVER (PARTITION BY file ORDER BY count(*) DESC, folder) AS rn FROM (SELECT file, unnest(words) AS w FROM f) x JOIN d USING (w) WHERE length(w) > 2 GROUP BY 1, 2)
 SELECT f.file, coalesce(CAST(v.folder AS VARCHAR), m.folder, h.folder) AS folder, round(coalesce(v.cosine, m.score, h.c), 6) AS score, CASE WHEN v.folder IS NOT NULL THEN 'vector' WHEN m.folder IS NOT NULL THEN 'model' WHEN h.folder IS NOT NULL THEN 'words' END AS method FROM f LEFT JOIN v USING (file) LEFT JOIN m USING (file) LEFT JOIN (SELECT * FROM h WHERE rn = 1) h USING (file)""")
def folder_cascade(spark, sf):
    """Clusters are folders for vectors, languages a model's answer for every third file, nations the folders that words meet."""
    docs = table(spark, sf, "documents")
    files = docs.select(F.col("doc_id").alias("file"), F.split("text", "[^A-Za-z]+").alias("words"))
    near = nearest_folder(spark, sf).select(F.col("doc_id").alias("file"), "folder", "cosine")
    modelled = docs.where("doc_id % 3 = 0").select(F.col("doc_id").alias("file"), F.col("lang").alias("folder"), F.lit(0.5).alias("score"))
    folders = table(spark, sf, "nation").select(F.col("n_name").alias("folder"), F.concat("n_name", F.lit(" of the land that was")).alias("text"))
    return R.folder_cascade(files, near, modelled, folders, least=0.3).select("file", "folder", F.round("score", 6).alias("score"), "method")

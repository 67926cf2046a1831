"""Queries over the history table: scans and sinks, lookups and pages, aggregates, windows."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.operators import history as H
from corpusloom.operators.ordered import append_in_order, numbered_in_keys
from corpusloom.plans.registry import query
from corpusloom.session import table
from corpusloom.streaming import events as E

#: The history table for DuckDB, by the same rules as ``operators.history.history``.
HIST = """WITH h AS (SELECT doc_id, lang, source AS category, CASE doc_id % 5 WHEN 0 THEN 'pdf' WHEN 1 THEN 'docx' WHEN 2 THEN 'csv' WHEN 3 THEN 'png' ELSE 'txt' END AS ext,
 'doc' || doc_id || '.' || CASE doc_id % 5 WHEN 0 THEN 'pdf' WHEN 1 THEN 'docx' WHEN 2 THEN 'csv' WHEN 3 THEN 'png' ELSE 'txt' END AS file_name,
 '/' || source || '/' || lang || '/doc' || doc_id || '.' || CASE doc_id % 5 WHEN 0 THEN 'pdf' WHEN 1 THEN 'docx' WHEN 2 THEN 'csv' WHEN 3 THEN 'png' ELSE 'txt' END AS path,
 n_chars AS size, (doc_id * 37) % 101 AS confidence, CAST(1704067200 + doc_id * 3600 AS BIGINT) AS ts, [lang, 'tag' || (doc_id % 7)] AS tags, (doc_id * 13) % 500 AS ms, text FROM documents) """
MONTH = "strftime(make_timestamp(ts * 1000000), '%Y-%m')"


@query("partition_by_modality", HIST + "SELECT CASE WHEN ext = 'png' THEN 'image' ELSE 'document' END AS modality, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM h GROUP BY 1")
def partition_by_modality(spark, sf):
    h = H.history(spark, sf)
    return h.groupBy(F.when(F.col("ext") == "png", "image").otherwise("document").alias("modality")).agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


@query("truncate_text", "SELECT doc_id, CASE WHEN length(text) > 5000 THEN substring(text, 1, 5000) || '[truncated]' ELSE text END AS text FROM documents")
def truncate_text(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", F.when(F.length(t) > 5000, F.concat(F.substring(t, 1, 5000), F.lit("[truncated]"))).otherwise(t).alias("text"))


@query("upsert_vectors", """WITH new AS (SELECT vec_id + 50 AS vec_id, list_transform(embedding, lambda x: -x) AS embedding FROM embeddings WHERE vec_id % 3 = 0),
 u AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM new) UNION ALL SELECT * FROM new)
 SELECT vec_id, len(list_filter(embedding, lambda x: x <> 0)) > 0 AS has_vector, round(CAST(embedding[1] AS DOUBLE), 6) AS v0 FROM u""")
def upsert_vectors(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    new = e.where("vec_id % 3 = 0").select((F.col("vec_id") + 50).alias("vec_id"), F.transform("embedding", lambda x: -x).alias("embedding"))
    return H.upsert(e, new, "vec_id").select("vec_id", F.exists("embedding", lambda x: x != 0).alias("has_vector"), F.round(F.col("embedding")[0].cast("double"), 6).alias("v0"))


@query("upsert_split_invalid", "SELECT vec_id, CASE WHEN vec_id % 11 = 0 THEN 'invalid' WHEN vec_id % 2 = 0 THEN 'updated' ELSE 'inserted' END AS outcome FROM embeddings WHERE vec_id % 3 <> 1")
def upsert_split_invalid(spark, sf):
    """Even rows are stored, two thirds of all come, and every eleventh has too few components."""
    e = table(spark, sf, "embeddings")
    new = e.where("vec_id % 3 <> 1").select("vec_id", F.when(F.col("vec_id") % 11 == 0, F.slice("embedding", 1, 10)).otherwise(F.col("embedding")).alias("embedding"))
    return H.upsert_report(e.where("vec_id % 2 = 0").select("vec_id", "embedding"), new, "vec_id", F.size("embedding") == 64)[1]


@query("delete_antijoin", "SELECT vec_id, label FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def delete_antijoin(spark, sf):
    gone = table(spark, sf, "labels").where("quality = 0").select(F.col("doc_id").alias("vec_id"))
    return table(spark, sf, "embeddings").select("vec_id", "label").join(gone, "vec_id", "left_anti")


@query("rekey_paths", HIST + "SELECT h.doc_id, coalesce(m.new_path, h.path) AS path, coalesce(m.new_name, h.file_name) AS file_name FROM h LEFT JOIN (SELECT doc_id, '/moved/' || file_name AS new_path, 'moved-' || file_name AS new_name FROM h WHERE doc_id % 10 = 3) m USING (doc_id)")
def rekey_paths(spark, sf):
    h = H.history(spark, sf)
    moves = h.where("doc_id % 10 = 3").select("doc_id", F.concat(F.lit("/moved/"), "file_name").alias("new_path"), F.concat(F.lit("moved-"), "file_name").alias("new_name"))
    return h.join(moves, "doc_id", "left").select("doc_id", F.coalesce("new_path", "path").alias("path"), F.coalesce("new_name", "file_name").alias("file_name"))


@query("clone_rows", HIST + "SELECT path, category FROM h UNION ALL SELECT '/copy' || path, category FROM h WHERE doc_id % 20 = 1")
def clone_rows(spark, sf):
    h = H.history(spark, sf)
    return h.select("path", "category").unionByName(h.where("doc_id % 20 = 1").select(F.concat(F.lit("/copy"), "path").alias("path"), "category"))


@query("mark_orphaned", "SELECT e.vec_id, l.doc_id IS NULL AS is_orphaned, CASE WHEN l.doc_id IS NULL THEN 1706745600 END AS orphaned_at FROM embeddings e LEFT JOIN labels l ON e.vec_id = l.doc_id")
def mark_orphaned(spark, sf):
    alive = table(spark, sf, "labels").select(F.col("doc_id").alias("vec_id"), F.lit(True).alias("alive"))
    e = table(spark, sf, "embeddings").select("vec_id").join(alive, "vec_id", "left")
    return e.select("vec_id", F.col("alive").isNull().alias("is_orphaned"), F.when(F.col("alive").isNull(), 1706745600).alias("orphaned_at"))


QUOTED = "CAST(to_json({}) AS VARCHAR)"
SUBJECT = "substring(text, 1, 40)"


@query("export_csv_rows", HIST + "SELECT doc_id, " + " || ',' || ".join(QUOTED.format(c) for c in ("file_name", "path", "category", "CAST(confidence AS VARCHAR)", "array_to_string(tags, '; ')", SUBJECT, "strftime(make_timestamp(ts * 1000000), '%Y-%m-%dT%H:%M:%S.000Z')")) + " AS line FROM h WHERE text IS NOT NULL")
def export_csv_rows(spark, sf):
    h = H.history(spark, sf).where("text IS NOT NULL").withColumn("subject", F.substring("text", 1, 40))
    return H.exported(h, "csv").select("doc_id", "line")


@query("export_json_rows", HIST + "SELECT doc_id, '{\"fileName\":' || " + QUOTED.format("file_name") + " || ',\"originalPath\":' || " + QUOTED.format("path") + " || ',\"category\":' || " + QUOTED.format("category") + " || ',\"confidence\":' || confidence || ',\"keywords\":' || CAST(to_json(tags) AS VARCHAR) || ',\"subject\":' || " + QUOTED.format(SUBJECT) + " || ',\"timestamp\":\"' || strftime(make_timestamp(ts * 1000000), '%Y-%m-%dT%H:%M:%S.000Z') || '\"}' AS line FROM h WHERE text IS NOT NULL")
def export_json_rows(spark, sf):
    h = H.history(spark, sf).where("text IS NOT NULL").withColumn("subject", F.substring("text", 1, 40))
    return H.exported(h, "json").select("doc_id", "line")


@query("collection_stats", "SELECT 'files' AS collection, count(*) AS n FROM documents UNION ALL SELECT 'vectors', count(*) FROM embeddings UNION ALL SELECT 'folders', count(DISTINCT source) FROM documents UNION ALL SELECT 'feedback', count(*) FROM labels")
def collection_stats(spark, sf):
    one = lambda name, df, n: df.agg(n.alias("n")).select(F.lit(name).alias("collection"), "n")
    d = table(spark, sf, "documents")
    out = one("files", d, F.count("*")).unionByName(one("vectors", table(spark, sf, "embeddings"), F.count("*")))
    return out.unionByName(one("folders", d, F.count_distinct("source"))).unionByName(one("feedback", table(spark, sf, "labels"), F.count("*")))


@query("lookup_by_id", "SELECT doc_id, lang, source, n_chars FROM documents WHERE doc_id = 42")
def lookup_by_id(spark, sf):
    return table(spark, sf, "documents").where("doc_id = 42").select("doc_id", "lang", "source", "n_chars")


@query("lookup_by_path", HIST + "SELECT doc_id, path FROM h WHERE path IN ('/src4/en/doc4.txt', (SELECT max(path) FROM h))")
def lookup_by_path(spark, sf):
    """Exact paths, and one that is only the same when made plain."""
    h = H.history(spark, sf).select("doc_id", "path")
    path = h.agg(F.max("path")).first()[0] or ""
    return H.lookup(h, "/src4/en/doc4.txt").unionByName(H.lookup(h, path.replace("/", "\\\\"))).distinct()


@query("lookup_by_hash", HIST + ", w AS (SELECT DISTINCT sha256(text) AS hash FROM h WHERE doc_id % 9 = 0) SELECT hash, max(doc_id) AS doc_id FROM h JOIN w ON sha256(text) = hash GROUP BY 1")
def lookup_by_hash(spark, sf):
    """The newest file with each of the contents asked for."""
    h = H.history(spark, sf)
    asked = h.where("doc_id % 9 = 0").select(F.sha2("text", 256).alias("hash"))
    return H.lookup_hashes(h, asked, F.sha2("text", 256)).select("hash", "doc_id")


@query("by_category_page", HIST + "SELECT doc_id, category, ts, (SELECT count(*) FROM h WHERE category = 'src3') AS total, (SELECT count(*) FROM h WHERE category = 'src3') > 30 AS has_more FROM h WHERE category = 'src3' ORDER BY ts DESC, doc_id LIMIT 20 OFFSET 10")
def by_category_page(spark, sf):
    return H.page(H.history(spark, sf).where("category = 'src3'").select("doc_id", "category", "ts"), [F.desc("ts"), F.asc("doc_id")], 10, 20)


@query("by_tag_page", HIST + "SELECT doc_id, ts, (SELECT count(*) FROM h WHERE list_contains(tags, 'tag2')) AS total, (SELECT count(*) FROM h WHERE list_contains(tags, 'tag2')) > 25 AS has_more FROM h WHERE list_contains(tags, 'tag2') ORDER BY ts DESC LIMIT 25")
def by_tag_page(spark, sf):
    return H.page(H.history(spark, sf).where(F.array_contains("tags", "tag2")).select("doc_id", "ts"), [F.desc("ts"), F.asc("doc_id")], 0, 25)


@query("by_date_range", HIST + f"SELECT doc_id, ts, {MONTH} AS month FROM h WHERE ts BETWEEN 1704200000 AND 1705500000")
def by_date_range(spark, sf):
    h = H.history(spark, sf).where(F.col("ts").between(1704200000, 1705500000))
    return h.select("doc_id", "ts", H.month_of(F.col("ts")).alias("month"))


@query("recent_page", HIST + "SELECT doc_id, ts FROM h ORDER BY ts DESC LIMIT 50 OFFSET 20")
def recent_page(spark, sf):
    return H.history(spark, sf).select("doc_id", "ts").orderBy(F.desc("ts"), "doc_id").offset(20).limit(50)


@query("sort_entries", HIST + "SELECT doc_id, file_name, confidence, row_number() OVER (PARTITION BY category ORDER BY coalesce(confidence, 0) DESC, file_name, doc_id) AS pos FROM h")
def sort_entries(spark, sf):
    """Places in each category, of which one may have most files: numbered by ranges and counts."""
    h = H.history(spark, sf).select("doc_id", "file_name", "confidence", "category", (-F.coalesce("confidence", F.lit(0))).alias("falling"))
    placed = numbered_in_keys(h, "category", ["falling", "file_name", "doc_id"], "before")
    return placed.select("doc_id", "file_name", "confidence", (F.col("before") + 1).cast("long").alias("pos"))


@query("ghost_filter", "SELECT d.doc_id, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE source END AS source FROM documents d WHERE doc_id % 9 = 0 OR EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = d.doc_id)")
def ghost_filter(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 9 != 0, F.col("source")).alias("source"))
    known = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return d.where("source IS NULL").unionByName(d.where("source IS NOT NULL").join(known, "doc_id", "left_semi"))


@query("peek_files", "SELECT vec_id, label FROM embeddings ORDER BY vec_id LIMIT 25")
def peek_files(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", "label").orderBy("vec_id").limit(25)


@query("orphans_aged", "SELECT vec_id, orphaned_at FROM (SELECT vec_id, CASE WHEN vec_id % 4 <> 0 THEN 1700000000 + vec_id * 10000 END AS orphaned_at FROM embeddings WHERE vec_id % 3 = 0) WHERE orphaned_at IS NULL OR orphaned_at < 1702000000")
def orphans_aged(spark, sf):
    o = table(spark, sf, "embeddings").where("vec_id % 3 = 0").select("vec_id", F.when(F.col("vec_id") % 4 != 0, F.lit(1700000000) + F.col("vec_id") * 10000).alias("orphaned_at"))
    return o.where("orphaned_at IS NULL OR orphaned_at < 1702000000")


@query("longest_prefix_folder", HIST + """, f AS (SELECT DISTINCT '/' || category AS folder FROM h UNION SELECT DISTINCT '/' || category || '/' || lang FROM h WHERE lang IN ('en', 'fr'))
 SELECT doc_id, folder FROM (SELECT doc_id, folder, row_number() OVER (PARTITION BY doc_id ORDER BY length(folder) DESC) AS rn FROM h JOIN f ON starts_with(path, folder || '/')) WHERE rn = 1""")
def longest_prefix_folder(spark, sf):
    """Every ancestor of a path is a key, so the prefix search is an equi-join."""
    h = H.history(spark, sf).select("doc_id", "path", "category", "lang")
    folders = h.select(F.concat(F.lit("/"), "category").alias("folder")).distinct().union(h.where("lang IN ('en', 'fr')").select(F.concat(F.lit("/"), "category", F.lit("/"), "lang")).distinct())
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(2), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    return H.latest_per_key(h.select("doc_id", F.explode(above).alias("folder")).join(folders, "folder"), "doc_id", F.length("folder").desc()).select("doc_id", "folder")


@query("file_stats", HIST + "SELECT count(*) AS total, count(*) FILTER (confidence >= 50) AS ready, count(*) FILTER (confidence < 10) AS failed, count(*) - count(*) FILTER (confidence >= 50) - count(*) FILTER (confidence < 10) AS pending FROM h")
def file_stats(spark, sf):
    s = H.history(spark, sf).agg(F.count("*").alias("total"), F.count_if(F.col("confidence") >= 50).alias("ready"), F.count_if(F.col("confidence") < 10).alias("failed"))
    return s.withColumn("pending", F.expr("total - ready - failed"))


GATE = "CASE WHEN doc_id % 5 = 0 THEN false WHEN doc_id % 3 = 0 AND confidence < 50 THEN false WHEN ms % 4 = 0 THEN false WHEN ms % 4 = 1 THEN true WHEN ms % 4 = 2 THEN false ELSE false END"


@query("embedding_gate", HIST + f"SELECT doc_id, {GATE} AS embeds FROM h")
def embedding_gate(spark, sf):
    """Policy, scope and timing, in this order; the stage asked about is 'analysis'."""
    h = H.history(spark, sf).withColumns({"policy": F.when(F.col("doc_id") % 5 == 0, "skip").otherwise("embed"), "scope": F.when(F.col("doc_id") % 3 == 0, "smart_folders_only").otherwise("all"), "timing": F.element_at(F.array(*map(F.lit, ("manual", "during_analysis", "after_organize", "other"))), (F.col("ms") % 4 + 1).cast("int"))})
    gate = F.when(F.col("policy") != "embed", False).when((F.col("scope") == "smart_folders_only") & (F.col("confidence") < 50), False).when(F.col("timing") == "manual", False).otherwise(F.col("timing") == "during_analysis")
    return h.select("doc_id", gate.alias("embeds"))


@query("category_counts", HIST + "SELECT category, count(*) AS n FROM h GROUP BY 1")
def category_counts(spark, sf):
    return H.history(spark, sf).groupBy("category").agg(F.count("*").alias("n"))


@query("tag_counts", HIST + "SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM h) GROUP BY 1")
def tag_counts(spark, sf):
    return H.history(spark, sf).select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


@query("top_items", "SELECT p_type AS item, count(*) AS n FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top_items(spark, sf):
    return table(spark, sf, "part").groupBy(F.col("p_type").alias("item")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "item").limit(10)


@query("size_distribution", HIST + "SELECT CASE WHEN size < 1024 THEN 'tiny' WHEN size < 1048576 THEN 'small' WHEN size < 10485760 THEN 'medium' WHEN size < 104857600 THEN 'large' ELSE 'huge' END AS range, count(*) AS n FROM h GROUP BY 1")
def size_distribution(spark, sf):
    return H.history(spark, sf).groupBy(H.size_range(F.col("size")).alias("range")).agg(F.count("*").alias("n"))


@query("statistics", HIST + "SELECT count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes, count(DISTINCT category) AS categories, (SELECT count(DISTINCT t) FROM (SELECT unnest(tags) AS t FROM h)) AS tags, round(avg(confidence), 6) AS avg_confidence, round(avg(ms), 6) AS avg_ms, min(ts) AS first_ts, max(ts) AS last_ts, count(*) = 0 AS is_empty FROM h")
def statistics(spark, sf):
    h = H.history(spark, sf)
    tags = h.select(F.explode("tags").alias("t")).select(F.count_distinct("t")).scalar()
    return h.agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.count_distinct("category").alias("categories"), F.round(F.avg("confidence"), 6).alias("avg_confidence"), F.round(F.avg("ms"), 6).alias("avg_ms"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")).withColumn("tags", tags).withColumn("is_empty", F.col("n") == 0)


@query("quick_stats", HIST + "SELECT count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes, max(ts) AS last_ts FROM h")
def quick_stats(spark, sf):
    return H.history(spark, sf).agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.max("ts").alias("last_ts"))


@query("incremental_stats", "SELECT event_type, CAST(sum(CASE WHEN event_id % 4 = 0 THEN -1 ELSE 1 END) AS BIGINT) AS n, round(sum(CASE WHEN event_id % 4 = 0 THEN -value ELSE value END), 4) AS total FROM events GROUP BY 1")
def incremental_stats(spark, sf):
    sign = F.when(F.col("event_id") % 4 == 0, -1).otherwise(1)
    return table(spark, sf, "events").groupBy("event_type").agg(F.sum(sign).alias("n"), F.round(F.sum(sign * F.col("value")), 4).alias("total"))


@query("month_counts", HIST + f"SELECT {MONTH} AS month, count(*) AS n FROM h GROUP BY 1")
def month_counts(spark, sf):
    return H.history(spark, sf).groupBy(H.month_of(F.col("ts")).alias("month")).agg(F.count("*").alias("n"))


@query("dominant_category", HIST + "SELECT lang, category, n FROM (SELECT lang, category, count(*) AS n, min(doc_id) AS f, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, min(doc_id)) AS rn FROM h GROUP BY 1, 2) WHERE rn = 1")
def dominant_category(spark, sf):
    return H.most_frequent(H.history(spark, sf), "lang", "category", "doc_id")


@query("common_tags", HIST + ", t AS (SELECT category, doc_id, unnest(CASE WHEN doc_id % 2 = 0 THEN [upper(lang), 'tag' || (doc_id % 7), '42', 'x'] ELSE [lang, 'tag' || (doc_id % 7), '42', 'x'] END) AS tag FROM h), n AS (SELECT category, count(*) AS total FROM h GROUP BY 1), g AS (SELECT category, lower(tag) AS form, count(*) AS n, min_by(tag, doc_id) AS tag FROM t WHERE length(tag) > 1 AND tag <> '42' GROUP BY 1, 2) SELECT g.category, tag, n, row_number() OVER (PARTITION BY g.category ORDER BY n DESC, form) AS rank FROM g JOIN n USING (category) WHERE n >= ceil(0.4 * total)")
def common_tags(spark, sf):
    shown = F.when(F.col("doc_id") % 2 == 0, F.upper("lang")).otherwise(F.col("lang"))
    h = H.history(spark, sf).withColumn("tags", F.array(shown, F.element_at("tags", -1), F.lit("42"), F.lit("x")))
    return H.common_tags(h, "category", id_col="doc_id").withColumn("rank", F.col("rank").cast("long"))

@query("cluster_time_range", "SELECT label, min(ts) AS first_ts, max(ts) AS last_ts FROM (SELECT label, 1704067200 + vec_id * 3600 AS ts FROM embeddings) GROUP BY 1")
def cluster_time_range(spark, sf):
    stamp = F.coalesce(F.try_to_timestamp(F.lit("no date")), F.timestamp_seconds(F.lit(1704067200) + F.col("vec_id") * 3600))
    return table(spark, sf, "embeddings").groupBy("label").agg(F.unix_timestamp(F.min(stamp)).alias("first_ts"), F.unix_timestamp(F.max(stamp)).alias("last_ts"))


@query("chunk_to_file_max", "SELECT user_id, event_id, value FROM (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rn FROM events) WHERE rn = 1")
def chunk_to_file_max(spark, sf):
    return H.latest_per_key(table(spark, sf, "events").select("user_id", "event_id", "value"), "user_id", F.desc("value"), F.asc("event_id"))


@query("file_patterns", HIST + """, f AS (SELECT doc_id, lang AS grp, lower(file_name) AS name, ext, CASE WHEN doc_id % 2 = 0 THEN lang END AS project, category, strftime(make_timestamp(ts * 1000000), '%Y-%m-%d') AS date FROM h),
 w AS (SELECT grp, unnest(list_filter(string_split_regex(name, '[^a-z0-9]+'), lambda w: length(w) > 3)) AS w FROM f), n AS (SELECT grp, count(*) AS n FROM f GROUP BY 1), tm AS (SELECT grp, list_sort(list(w)) AS terms FROM (SELECT grp, w FROM w JOIN n USING (grp) GROUP BY grp, w, n HAVING count(*) > 0.3 * n) GROUP BY 1),
 c AS (SELECT grp, category, row_number() OVER (PARTITION BY grp ORDER BY count(*) DESC, min(doc_id)) AS rn FROM f GROUP BY 1, 2)
 SELECT f.grp, CASE WHEN count(DISTINCT project) = 1 THEN min(project) END AS project, min(date) AS first_date, max(date) AS last_date, CASE WHEN min(date) = max(date) THEN 'Single date: ' || min(date) ELSE min(date) || ' to ' || max(date) END AS dates, list_sort(list(DISTINCT ext)) AS types, max(c.category) AS category, coalesce(max(tm.terms), []) AS terms FROM f LEFT JOIN c ON c.grp = f.grp AND rn = 1 LEFT JOIN tm ON tm.grp = f.grp GROUP BY 1""")
def file_patterns(spark, sf):
    h = H.history(spark, sf)
    f = h.select(F.col("lang").alias("grp"), F.col("doc_id").alias("id"), F.col("file_name").alias("name"), "ext", F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("project"), "category", F.date_format(F.timestamp_seconds("ts"), "yyyy-MM-dd").alias("date"))
    return H.file_patterns(f, "grp")

@query("batch_groups", HIST + "SELECT category AS folder, count(*) AS n, round(avg(confidence / 100.0), 6) AS confidence FROM h GROUP BY 1")
def batch_groups(spark, sf):
    return H.history(spark, sf).groupBy(F.col("category").alias("folder")).agg(F.count("*").alias("n"), F.round(F.avg(F.col("confidence") / 100), 6).alias("confidence"))


@query("latest_per_file", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def latest_per_file(spark, sf):
    return H.latest_per_key(table(spark, sf, "events").select("user_id", "event_id", "event_type", "ts"), "user_id", F.desc("ts"), F.desc("event_id")).drop("ts")


@query("dedupe_by_path", HIST + "SELECT size, max(confidence) AS score, min(doc_id) AS position FROM h GROUP BY 1")
def dedupe_by_path(spark, sf):
    return H.history(spark, sf).groupBy("size").agg(F.max("confidence").alias("score"), F.min("doc_id").alias("position"))


@query("pipeline_summary", "SELECT count(*) AS total, count(*) FILTER (event_type = 'error') AS errors, round(count(*) FILTER (event_type = 'error') * 1.0 / count(*), 6) AS error_rate, (SELECT count(*) FILTER (event_type = 'error') FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 200)) AS recent_errors FROM events")
def pipeline_summary(spark, sf):
    e = table(spark, sf, "events")
    bad = F.count_if(F.col("event_type") == "error")
    recent = e.orderBy(F.desc("ts"), F.desc("event_id")).limit(200).select(bad).scalar()
    return e.agg(F.count("*").alias("total"), bad.alias("errors"), F.round(bad / F.count("*"), 6).alias("error_rate")).withColumn("recent_errors", recent)


@query("health_score", "SELECT event_type, count(*) AS calls, round(avg(value), 4) AS avg_ms, round(avg(CASE WHEN user_id % 9 = 0 THEN 1.0 ELSE 0.0 END), 6) AS error_rate, round(coalesce(sum(event_id % 100) / nullif(sum(value), 0) * 1000, 0), 4) AS tokens_per_s, greatest(0, round(100 - avg(CASE WHEN user_id % 9 = 0 THEN 1.0 ELSE 0.0 END) * 30 - CASE WHEN avg(value) > 100 THEN least(20, (avg(value) - 100) / 10) ELSE 0 END)) AS score FROM events GROUP BY 1")
def health_score(spark, sf):
    """Values stand for milliseconds, ids for tokens, every ninth user's calls fail."""
    calls = table(spark, sf, "events").select("event_type", F.col("value").alias("ms"), (F.col("user_id") % 9 == 0).alias("failed"), (F.col("event_id") % 100).alias("tokens"))
    r = H.service_health(calls, "event_type")
    return r.select("event_type", "calls", F.round("avg_ms", 4).alias("avg_ms"), F.round("error_rate", 6).alias("error_rate"), F.round("tokens_per_s", 4).alias("tokens_per_s"), "score")

@query("feedback_by_source", "SELECT d.source, count(*) AS n, CAST(sum(quality) AS BIGINT) AS accepted, CAST(sum(toxic) AS BIGINT) AS rejected FROM labels l JOIN documents d USING (doc_id) GROUP BY 1")
def feedback_by_source(spark, sf):
    return table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id").groupBy("source").agg(F.count("*").alias("n"), F.sum("quality").alias("accepted"), F.sum("toxic").alias("rejected"))


@query("underutilized", "SELECT n.n_name AS folder, count(c.c_custkey) AS uses FROM nation n LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 9500) c ON c.c_nationkey = n.n_nationkey GROUP BY 1 HAVING count(c.c_custkey) < 3")
def underutilized(spark, sf):
    uses = table(spark, sf, "customer").where("c_acctbal > 9500").groupBy("c_nationkey").agg(F.count("*").alias("uses"))
    return table(spark, sf, "nation").join(uses, F.col("n_nationkey") == F.col("c_nationkey"), "left").select(F.col("n_name").alias("folder"), F.coalesce("uses", F.lit(0)).alias("uses")).where("uses < 3")


@query("parallel_edges", "WITH e AS (SELECT event_id, least(user_id, event_id % 50) AS a, greatest(user_id, event_id % 50) AS b FROM events) SELECT event_id, a, b, round(row_number() OVER (PARTITION BY a, b ORDER BY event_id) - (count(*) OVER (PARTITION BY a, b) + 1) / 2.0, 2) AS shift FROM e")
def parallel_edges(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.least("user_id", F.col("event_id") % 50).alias("a"), F.greatest("user_id", F.col("event_id") % 50).alias("b"))
    both = W.partitionBy("a", "b")
    return e.withColumn("shift", F.round(F.row_number().over(both.orderBy("event_id")) - (F.count("*").over(both) + 1) / F.lit(2.0), 2))


@query("missing_parent", "WITH f AS (SELECT DISTINCT p_name AS name FROM part UNION SELECT split_part(p_name, ' ', 1) FROM part GROUP BY 1 HAVING count(*) % 2 = 0) SELECT split_part(name, ' ', 1) AS parent, count(*) AS n FROM f WHERE contains(name, ' ') GROUP BY 1 HAVING count(*) > 2 AND split_part(name, ' ', 1) NOT IN (SELECT name FROM f)")
def missing_parent(spark, sf):
    """Names of parts are folders, and first words with an even number of parts; which first words are no folder?"""
    p = table(spark, sf, "part")
    even = p.groupBy(F.split("p_name", " ")[0].alias("name")).agg(F.count("*").alias("n")).where("n % 2 = 0").select("name")
    f = p.select(F.col("p_name").alias("name")).unionByName(even).distinct()
    groups = f.where(F.contains("name", F.lit(" "))).groupBy(F.split("name", " ")[0].alias("parent")).agg(F.count("*").alias("n")).where("n > 2")
    return groups.join(f, F.col("parent") == F.col("name"), "left_anti")


@query("topic_coverage", HIST + ", t AS (SELECT ext AS topic, count(DISTINCT CASE WHEN doc_id % 17 = 0 THEN category END) AS n FROM h GROUP BY 1) SELECT topic, n, CASE WHEN n >= 3 THEN 'well' ELSE 'thin' END AS coverage FROM t WHERE n >= 3 OR n = 1")
def topic_coverage(spark, sf):
    t = H.history(spark, sf).groupBy(F.col("ext").alias("topic")).agg(F.count_distinct(F.when(F.col("doc_id") % 17 == 0, F.col("category"))).alias("n"))
    return t.where("n >= 3 OR n = 1").withColumn("coverage", F.when(F.col("n") >= 3, "well").otherwise("thin"))


@query("retention_count", HIST + "SELECT category, doc_id FROM (SELECT category, doc_id, row_number() OVER (PARTITION BY category ORDER BY ts DESC, doc_id DESC) AS rn FROM h) WHERE rn <= 10")
def retention_count(spark, sf):
    w = W.partitionBy("category").orderBy(F.desc("ts"), F.desc("doc_id"))
    return H.history(spark, sf).select("category", "doc_id", F.row_number().over(w).alias("rn")).where("rn <= 10").drop("rn")


@query("minmax_normalize", HIST + "SELECT doc_id, round((size - (SELECT min(size) FROM h)) * 1.0 / ((SELECT max(size) FROM h) - (SELECT min(size) FROM h)), 6) AS score FROM h")
def minmax_normalize(spark, sf):
    h = H.history(spark, sf)
    low, high = h.select(F.min("size")).scalar(), h.select(F.max("size")).scalar()
    flat = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("size").cast("double")))
    return h.select("doc_id", "size", low.alias("low"), high.alias("high")).select("doc_id", F.round(F.when(F.col("high") > F.col("low"), (F.col("size") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(flat), 6).alias("score"))


OUTCOMES = "CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'fallback' ELSE 'primary' END"


def outcomes(spark, sf):
    kind = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "view", "fallback").otherwise("primary")
    return table(spark, sf, "events").select((F.col("user_id") % 3).cast("string").alias("pipeline"), F.col("event_id").alias("id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("s"), kind.alias("outcome"))


DEGRADED = """r AS (SELECT CAST(user_id % 3 AS VARCHAR) AS pipeline, event_id AS id, ts, count(*) OVER w AS n, sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) OVER w AS fallbacks, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER w AS errors FROM events WINDOW w AS (PARTITION BY user_id % 3 ORDER BY ts, event_id ROWS BETWEEN 199 PRECEDING AND CURRENT ROW)),
 d AS (SELECT pipeline, id, ts, n, CAST(fallbacks AS BIGINT) AS fallbacks, CAST(errors AS BIGINT) AS errors, n >= 20 AND (fallbacks >= 0.5 * n OR errors >= 0.2 * n) AS degraded FROM r)"""


@query("rolling_degradation", f"WITH {DEGRADED} SELECT pipeline, id, n, fallbacks, errors, degraded FROM d")
def rolling_degradation(spark, sf):
    return H.degradation(outcomes(spark, sf), error_rate=0.2).select("pipeline", "id", "n", "fallbacks", "errors", "degraded")


@query("degradation_alerts", f"""WITH RECURSIVE {DEGRADED}, e AS (SELECT pipeline, id, epoch_us(ts) AS s, row_number() OVER (PARTITION BY pipeline ORDER BY ts, id) AS k FROM d WHERE degraded),
 f AS (SELECT pipeline, id, k, s AS last, true AS hit FROM e WHERE k = 1 UNION ALL SELECT e.pipeline, e.id, e.k, CASE WHEN e.s - f.last >= 86400000000 THEN e.s ELSE f.last END, e.s - f.last >= 86400000000 FROM f JOIN e ON e.pipeline = f.pipeline AND e.k = f.k + 1)
 SELECT pipeline, id FROM f WHERE hit""")
def degradation_alerts(spark, sf):
    return H.degradation_alerts(H.degradation(outcomes(spark, sf), error_rate=0.2), 86_400.0)


@query("update_by_path", HIST + "SELECT doc_id, path, CASE WHEN doc_id % 6 = 0 THEN ['new', lang] ELSE tags END AS tags, CASE WHEN doc_id % 6 = 0 AND doc_id % 4 <> 0 THEN 'changed' ELSE category END AS category FROM h")
def update_by_path(spark, sf):
    """New tags for every sixth file, and a new category unless it is null."""
    h = H.history(spark, sf).select("doc_id", "path", "tags", "category")
    changes = h.where("doc_id % 6 = 0").select("path", F.array(F.lit("new"), F.element_at("tags", 1)).alias("tags"), F.when(F.col("doc_id") % 4 != 0, "changed").alias("category"))
    return H.update_by_key(h, changes, "path")


@query("move_paths", HIST + ", m AS (SELECT doc_id, CASE WHEN path = (SELECT min(path) FROM h) THEN '/one/file' WHEN starts_with(path, '/src1/') AND starts_with(path, '/src1/en/') THEN '/english' || substring(path, 9) WHEN starts_with(path, '/src1/') THEN '/first' || substring(path, 6) ELSE path END AS path FROM h) SELECT 'history' AS store, doc_id, path FROM m UNION ALL SELECT 'vectors', doc_id, path FROM m WHERE doc_id IN (SELECT vec_id FROM embeddings)")
def move_paths(spark, sf):
    """A file, a folder and a folder inside it move, in two stores at once."""
    h = H.history(spark, sf).select("doc_id", "path")
    v = h.join(table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_semi")
    moves = spark.createDataFrame([("/src1", "/first"), ("/src1/en", "/english")], "old_path string, new_path string").unionByName(h.agg(F.min("path").alias("old_path")).withColumn("new_path", F.lit("/one/file")))
    parts = H.move_paths({"history": (h, "path"), "vectors": (v, "path")}, moves)
    return parts["history"].withColumn("store", F.lit("history")).unionByName(parts["vectors"].withColumn("store", F.lit("vectors")))


@query("ready_queue", "SELECT event_id AS id FROM events WHERE event_type <> 'error' ORDER BY ts DESC, event_id DESC LIMIT 1000")
def ready_queue(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.when(F.col("event_type") != "error", "ready").otherwise("failed").alias("state"), "ts")
    return H.ready_queue(e).select("id")


@query("own_changes_suppressed", "SELECT event_id FROM events e WHERE event_type <> 'purchase' AND NOT EXISTS (SELECT 1 FROM events o WHERE o.event_type = 'purchase' AND o.user_id = e.user_id AND epoch(e.ts) >= epoch(o.ts) AND epoch(e.ts) < epoch(o.ts) + 36000)")
def own_changes_suppressed(spark, sf):
    """Purchases stand for our own operations on a user's path; for ten hours its other events are ours."""
    e = table(spark, sf, "events").select("event_id", "event_type", F.col("user_id").alias("path"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("s"))
    return E.not_our_own(e.where("event_type <> 'purchase'"), e.where("event_type = 'purchase'"), 36_000.0).select("event_id")

@query("message_sort_order", "WITH o AS (SELECT conv_id, max(turn) * 10 AS last FROM conversations WHERE turn < 2 AND conv_id % 3 <> 0 GROUP BY 1) SELECT conv_id, turn, coalesce(last, 0) + row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS sort_order FROM conversations LEFT JOIN o USING (conv_id) WHERE turn >= 2")
def message_sort_order(spark, sf):
    """Later turns are appended to the stored first two, which are stored ten apart and not for every conversation."""
    c = table(spark, sf, "conversations").select("conv_id", "turn")
    stored = c.where("turn < 2 AND conv_id % 3 <> 0").withColumn("sort_order", F.col("turn") * 10)
    return append_in_order(stored, c.where("turn >= 2"), "conv_id", ["turn"])


@query("rate_limit_window", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch(ts) RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) <= 5 AS allowed FROM events")
def rate_limit_window(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.col("user_id").alias("key"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("s"))
    return H.rate_limited(e, 5, 3600.0).select("event_id", "allowed")


@query("list_conversations", "SELECT conv_id, count(*) AS messages, max(turn) AS last_turn FROM conversations GROUP BY 1 ORDER BY messages DESC, conv_id LIMIT 20")
def list_conversations(spark, sf):
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("messages"), F.max("turn").alias("last_turn")).orderBy(F.desc("messages"), "conv_id").limit(20)


@query("conversation_messages", "SELECT conv_id, turn, role, text FROM conversations WHERE conv_id = 7 ORDER BY turn")
def conversation_messages(spark, sf):
    return table(spark, sf, "conversations").where("conv_id = 7").select("conv_id", "turn", "role", "text").orderBy("turn")


@query("search_conversations", "SELECT DISTINCT conv_id FROM conversations WHERE text ILIKE '%able%'")
def search_conversations(spark, sf):
    return table(spark, sf, "conversations").where(F.col("text").ilike("%able%")).select("conv_id").distinct()


@query("conversation_markdown", "SELECT conv_id, string_agg('**' || role || '**: ' || text, '\n\n' ORDER BY turn) AS markdown FROM conversations GROUP BY 1")
def conversation_markdown(spark, sf):
    line = F.concat(F.lit("**"), "role", F.lit("**: "), "text")
    lines = F.sort_array(F.collect_list(F.struct("turn", line.alias("line"))))
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n\n").alias("markdown"))

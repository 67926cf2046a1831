"""Search queries: benchmark items are the query texts, vectors of ids divisible by 50 the query vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import graph as G
from corpusloom.operators import search as S
from corpusloom.operators import vectors as V
from corpusloom.operators.history import history
from corpusloom.plans.graphs import GRAPH, concepts
from corpusloom.plans.history import HIST
from corpusloom.plans.registry import query
from corpusloom.plans.vectors import COS, queries, six
from corpusloom.session import cut_lineage, table

FIELDS = {"text": 2.5, "source": 1.5, "lang": 1.2}
TOK = "regexp_extract_all(lower({}), '[a-z0-9]{{2,}}')"
BM = (
    "q AS (SELECT DISTINCT item_id AS query, unnest(regexp_extract_all(lower(text), '[a-z0-9]{2,}')) AS term FROM benchmark), "
    "w AS (SELECT 'text' AS field, 2.5 AS boost, doc_id AS id, regexp_extract_all(lower(text), '[a-z0-9]{2,}') AS w FROM documents UNION ALL SELECT 'source', 1.5, doc_id, regexp_extract_all(lower(source), '[a-z0-9]{2,}') FROM documents UNION ALL SELECT 'lang', 1.2, doc_id, regexp_extract_all(lower(lang), '[a-z0-9]{2,}') FROM documents), "
    "st AS (SELECT field, count(*) AS docs, avg(len(w)) AS mean FROM w GROUP BY 1), "
    "p AS (SELECT field, boost, id, term, len, count(*) AS tf FROM (SELECT field, boost, id, len(w) AS len, unnest(w) AS term FROM w) WHERE term IN (SELECT term FROM q) GROUP BY ALL), "
    "df AS (SELECT field, term, count(*) AS df FROM p GROUP BY 1, 2), "
    "sc AS (SELECT id, term, boost * ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean)) AS s FROM p JOIN df USING (field, term) JOIN st USING (field)), "
    "b0 AS (SELECT query, id, round(sum(s), 9) AS score FROM q JOIN sc USING (term) GROUP BY 1, 2), "
    "b AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM b0) "
)
#: Vector results for the same queries: the vector of the query's id.
VEC = f"v0 AS (SELECT b.vec_id AS query, a.vec_id AS id, {COS} AS score FROM embeddings a, embeddings b WHERE b.vec_id IN (SELECT item_id FROM benchmark)), v AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM v0) WHERE rank <= 60) "
NORM = "CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE greatest(0, least(1, score)) END"


def texts(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query"), "text")


def keyword(spark, sf, k=60):
    return S.bm25(table(spark, sf, "documents"), texts(spark, sf), FIELDS, k=k)


def vector(spark, sf, k=60):
    return V.top_k(table(spark, sf, "embeddings"), item_vectors(spark, sf), k).select("query", F.col("vec_id").alias("id"), "score", "rank")


@query("bm25_index_terms", "SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]{2,}')) AS term FROM documents) GROUP BY 1, 2) GROUP BY 1")
def bm25_index_terms(spark, sf):
    return S.postings(table(spark, sf, "documents"), {"text": 1.0}).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query("bm25_topk", f"WITH {BM} SELECT query, id, round(score, 6) AS score, rank FROM b WHERE rank <= 20")
def bm25_topk(spark, sf):
    return keyword(spark, sf, 20).select("query", "id", six("score"), F.col("rank").cast("long").alias("rank"))


@query("search_mode_bm25", f"WITH {BM} SELECT query, id, round(score, 5) AS score FROM (SELECT query, id, {NORM} AS score FROM b WHERE rank <= 60 WINDOW w AS (PARTITION BY query)) WHERE score >= 0.15")
def search_mode_bm25(spark, sf):
    return S.normalised(keyword(spark, sf)).where("score >= 0.15").select("query", "id", F.round("score", 5).alias("score"))


@query("search_mode_vector", f"WITH {VEC} SELECT query, id, round(score, 5) AS score FROM (SELECT query, id, {NORM} AS score FROM v WINDOW w AS (PARTITION BY query)) WHERE score >= 0.15")
def search_mode_vector(spark, sf):
    return S.normalised(vector(spark, sf)).where("score >= 0.15").select("query", "id", F.round("score", 5).alias("score"))


@query("search_mode_fallback", f"WITH {BM}, {VEC}, a AS (SELECT query, id, score, rank, 'vector' AS mode FROM v WHERE rank <= 20 AND query % 3 <> 0 UNION ALL SELECT query, id, score, rank, 'bm25' FROM b WHERE rank <= 20 AND (query % 3 = 0 OR query NOT IN (SELECT vec_id FROM embeddings))) SELECT query, id, round(score, 6) AS score, rank, mode FROM a WHERE query % 10 <> 9 UNION ALL SELECT item_id, NULL, NULL, NULL, 'error' FROM benchmark WHERE item_id % 10 = 9")
def search_mode_fallback(spark, sf):
    """Every third query has no vector, and every tenth one character only."""
    q = texts(spark, sf).join(item_vectors(spark, sf), "query", "left").withColumn("embedding", F.when(F.col("query") % 3 != 0, F.col("embedding")))
    q = q.withColumn("text", F.when(F.col("query") % 10 == 9, " x ").otherwise(F.col("text")))
    docs, e = table(spark, sf, "documents"), table(spark, sf, "embeddings")
    near = lambda some: V.top_k(e, some.select("query", "embedding"), 20).withColumnRenamed("vec_id", "id")
    found, errors = S.by_mode(q, "vector", keyword=lambda some: S.bm25(docs, some, FIELDS, k=20), vector=near, hybrid=near)
    none = [F.lit(None).cast(t).alias(n) for n, t in (("id", "long"), ("score", "double"), ("rank", "long"))]
    return found.select("query", "id", six("score"), F.col("rank").cast("long").alias("rank"), "mode").unionByName(errors.select("query", *none, F.lit("error").alias("mode")))


CH = "c0 AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rn FROM v0), ch AS (SELECT query, floor(id / 4) * 4 AS id, max(score) AS score FROM c0 WHERE rn <= 240 GROUP BY 1, 2), chr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM ch) WHERE rank <= 60) "


def file_of():
    """Vectors in fours are the chunks of one file."""
    return F.floor(F.col("vec_id") / 4) * 4


def item_vectors(spark, sf):
    return table(spark, sf, "embeddings").join(texts(spark, sf).select(F.col("query").alias("vec_id")), "vec_id", "left_semi").select(F.col("vec_id").alias("query"), "embedding")


def chunk(spark, sf):
    return V.chunk_search(table(spark, sf, "embeddings"), item_vectors(spark, sf), files=60, chunks_each=240, file=file_of()).select("query", F.col("file").alias("id"), "score", "rank")


@query("chunk_search", f"WITH v0 AS (SELECT b.vec_id AS query, a.vec_id AS id, {COS} AS score FROM embeddings a, embeddings b WHERE b.vec_id % 50 = 0), c0 AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rn FROM v0), f AS (SELECT query, CAST(floor(id / 4) * 4 AS BIGINT) AS file, max(score) AS score, min_by(id, rn) AS chunk FROM c0 WHERE rn <= 80 GROUP BY 1, 2) SELECT query, file, round(score, 6) AS score, chunk FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, file) AS rank FROM f) WHERE rank <= 20")
def chunk_search(spark, sf):
    hits = V.chunk_search(table(spark, sf, "embeddings"), queries(spark, sf), file=file_of())
    return hits.select("query", "file", six("score"), "chunk")


@query("vector_search_tags", HIST + f""", q AS (SELECT vec_id AS query, embedding, list_filter([lower(d.source), d.lang, 'tag' || (vec_id % 7)], lambda w: length(w) > 2) AS words FROM embeddings JOIN documents d ON d.doc_id = vec_id WHERE vec_id % 50 = 0),
 s AS (SELECT query, a.vec_id AS id, words, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS score FROM embeddings a, q WHERE a.label <> 3), t AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM s)
 SELECT query, id, round(score, 6) AS score, list_filter(coalesce(tags, []), lambda t: len(list_filter(words, lambda w: contains(lower(t), w))) > 0) AS tags, len(list_filter(words, lambda w: contains(lower(coalesce(category, '')), w))) > 0 AS in_category FROM t LEFT JOIN h ON h.doc_id = id WHERE rank <= 20""")
def vector_search_tags(spark, sf):
    """Nearest vectors outside cluster 3, and where the query's words stand in their tags and category."""
    words = F.concat_ws(" ", "source", "lang", F.concat(F.lit("Tag"), (F.col("vec_id") % 7).cast("string")))
    asked = table(spark, sf, "embeddings").where("vec_id % 50 = 0").join(table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), "source", "lang"), "vec_id").select(F.col("vec_id").alias("query"), "embedding", words.alias("text"))
    meta = history(spark, sf).select(F.col("doc_id").alias("id"), "tags", "category")
    return S.search_with_matches(table(spark, sf, "embeddings"), asked, meta, where=F.col("label") != 3).select("query", "id", six("score"), "tags", "in_category")


PARTS = f"nb AS (SELECT query, id, {NORM} AS score FROM b WHERE rank <= 60 WINDOW w AS (PARTITION BY query)), nv AS (SELECT query, id, {NORM} AS score FROM v WINDOW w AS (PARTITION BY query)), nc AS (SELECT query, id, {NORM} AS score FROM chr WINDOW w AS (PARTITION BY query)) "
HYBRID = f"WITH {BM}, {VEC}, {CH}, {PARTS}, f AS (SELECT query, id, round(sum(score), 9) AS score FROM (SELECT query, id, 0.25 * score AS score FROM nb UNION ALL SELECT query, id, 0.375 * score FROM nv UNION ALL SELECT query, CAST(id AS BIGINT), 0.375 * score FROM nc) GROUP BY 1, 2), hy AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM f) WHERE rank <= 30 AND score >= 0.15) "


def hybrid_results(spark, sf):
    """Vectors are searched once: the first of the chunks' hits are the files' own."""
    e, asked = table(spark, sf, "embeddings"), item_vectors(spark, sf)
    hits = cut_lineage(V.top_k(e, asked, 240))
    near = hits.where("rank <= 60").select("query", F.col("vec_id").alias("id"), "score", "rank")
    parts = V.chunk_search(e, asked, files=60, chunks_each=240, file=file_of(), hits=hits).select("query", F.col("file").alias("id"), "score", "rank")
    return S.hybrid(keyword(spark, sf), near, parts)


@query("hybrid_search", HYBRID + "SELECT query, id, round(score, 5) AS score, rank FROM hy")
def hybrid_search(spark, sf):
    return hybrid_results(spark, sf).select("query", "id", F.round("score", 5).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("rrf_fusion", f"WITH {BM}, {VEC}, {CH}, {PARTS}, r AS (SELECT query, id, 1.0 / (60 + rank) AS r, s.score FROM b JOIN nb s USING (query, id) UNION ALL SELECT query, id, 1.0 / (60 + rank), s.score FROM v JOIN nv s USING (query, id)), g AS (SELECT query, id, sum(r) AS r, max(score) AS best FROM r GROUP BY 1, 2) SELECT query, id, round(0.7 * r / greatest(max(r) OVER (PARTITION BY query), 0.001) + 0.3 * best, 5) AS score FROM g")
def rrf_fusion(spark, sf):
    return S.reciprocal_rank_fusion([keyword(spark, sf), vector(spark, sf)]).select("query", "id", F.round("score", 5).alias("score"))


@query("weighted_rrf", f"WITH {BM}, {VEC} SELECT query, id, round(round(sum(s), 9), 7) AS score FROM (SELECT query, id, 0.7 / (60 + rank + 1) AS s FROM v UNION ALL SELECT query, id, 0.3 / (60 + rank + 1) FROM b WHERE rank <= 60) GROUP BY 1, 2")
def weighted_rrf(spark, sf):
    part = lambda df, w: df.select("query", "id", (1.0 / (S.RRF + F.col("rank") + 1)).alias("score"))
    return S.fuse({"v": (part(vector(spark, sf), 0.7), 0.7), "b": (part(keyword(spark, sf), 0.3), 0.3)}).select("query", "id", F.round("score", 7).alias("score"))


@query("rerank_merge", HYBRID + ", pp AS (SELECT *, CASE WHEN rank <= 10 THEN (id % 11) / 10.0 END AS points FROM hy) SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY points IS NULL, points DESC, rank) AS new_rank FROM pp")
def rerank_merge(spark, sf):
    """A stand-in scorer gives id modulo 11 points; a model's scores take its place."""
    return S.rerank(hybrid_results(spark, sf), (F.col("id") % 11).cast("double")).select("query", "id", F.col("new_rank").cast("long").alias("new_rank"))


@query("graph_expansion", GRAPH.rstrip() + f", {BM}, s AS (SELECT query, id, score FROM b WHERE rank <= 15), bo AS (SELECT source AS id, target AS other, weight FROM g2 UNION ALL SELECT target, source, weight FROM g2), n AS (SELECT s.query, bo.other AS id, max(s.score * least(1.0, bo.weight * 1.0 / (SELECT max(weight) FROM g2)) * 0.6) AS n FROM s JOIN bo ON bo.id = s.id WHERE NOT EXISTS (SELECT 1 FROM s x WHERE x.query = s.query AND x.id = bo.other) GROUP BY 1, 2), n2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY n DESC, id) AS k FROM n) WHERE k <= 120) SELECT query, id, round(sum(score), 5) AS score FROM (SELECT query, id, score FROM b WHERE rank <= 60 UNION ALL SELECT query, id, n * 0.2 FROM n2) GROUP BY 1, 2")
def graph_expansion(spark, sf):
    return S.graph_expand(keyword(spark, sf), G.concept_edges(concepts(spark, sf))).select("query", "id", F.round("score", 5).alias("score"))


@query("enrich_left_join", "SELECT e.vec_id, coalesce(d.source, 'label' || e.label) AS folder FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id")
def enrich_left_join(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), "source")
    return table(spark, sf, "embeddings").join(d, "vec_id", "left").select("vec_id", F.coalesce("source", F.concat(F.lit("label"), F.col("label").cast("string"))).alias("folder"))


@query("chunk_parent_join", "SELECT e.vec_id, coalesce(d.lang, '') AS lang, CASE WHEN d.doc_id IS NULL THEN 'document' ELSE d.source END AS kind FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id * 2")
def chunk_parent_join(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "source")
    e = table(spark, sf, "embeddings").select("vec_id", (F.col("vec_id") * 2).alias("doc_id")).join(d, "doc_id", "left")
    return e.select("vec_id", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("document")).alias("kind"))


@query("orphan_chunks", "SELECT conv_id, turn FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = c.conv_id)")
def orphan_chunks(spark, sf):
    known = table(spark, sf, "labels").select(F.col("doc_id").alias("conv_id"))
    return table(spark, sf, "conversations").select("conv_id", "turn").join(known, "conv_id", "left_anti")


CHUNKS = """cc AS (SELECT doc_id AS id, at, substring(text, CAST(at + 1 AS BIGINT), 1000) AS raw FROM (SELECT doc_id, text, unnest(generate_series(0, greatest(CAST(ceil((length(text) - 1000) / 800.0) AS BIGINT), 0) * 800, 800)) AS at FROM documents WHERE length(text) > 0)),
 ct AS (SELECT id, at + length(raw) - length(regexp_replace(raw, '^[ \\t\\r\\n]+', '')) AS start, regexp_replace(regexp_replace(raw, '^[ \\t\\r\\n]+', ''), '[ \\t\\r\\n]+$', '') AS chunk FROM cc),
 ci AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY start) - 1 AS index, start, start + length(chunk) AS "end", chunk FROM ct WHERE chunk <> '') """.replace(" at,", " pos,").replace("(at ", "(pos ").replace("AS at ", "AS pos ").replace(" at + ", " pos + ")


@query("chunk_text", f'WITH {CHUNKS} SELECT id, index, start, "end", chunk FROM ci WHERE index < 80')
def chunk_text(spark, sf):
    return S.chunks(table(spark, sf, "documents")).select("id", F.col("index").cast("long").alias("index"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "chunk")


@query("chunk_context", f"WITH {CHUNKS}, h AS (SELECT id, index FROM ci WHERE index < 80 AND index % 3 = 1) SELECT h.id, h.index, substring(trim(string_agg(c.chunk, chr(10) ORDER BY c.index)), 1, 2000) AS context FROM h JOIN ci c ON c.id = h.id AND abs(c.index - h.index) <= 1 AND c.index < 80 GROUP BY 1, 2")
def chunk_context(spark, sf):
    parts = S.chunks(table(spark, sf, "documents"))
    return S.chunk_context(parts.where("index % 3 = 1"), parts).select("id", F.col("index").cast("long").alias("index"), "context")


@query("match_details", f"WITH {BM} SELECT query, id, list_sort(list(DISTINCT term)) AS terms FROM b JOIN q USING (query) JOIN documents d ON d.doc_id = id WHERE rank <= 10 AND contains(lower(d.text), term) GROUP BY 1, 2")
def match_details(spark, sf):
    q = texts(spark, sf).select("query", F.explode(F.array_distinct(S.tokens(F.col("text")))).alias("term"))
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.lower("text").alias("t"))
    return keyword(spark, sf, 10).join(d, "id").join(q, "query").where(F.contains("t", "term")).groupBy("query", "id").agg(F.sort_array(F.collect_set("term")).alias("terms"))


@query("weighted_keyword_search", HIST + f""", v AS (SELECT a.vec_id AS id, {COS} AS cosine FROM embeddings a, embeddings b WHERE b.vec_id = 0), n AS (SELECT id AS nid, cosine FROM v JOIN (SELECT doc_id FROM h ORDER BY ts DESC, doc_id DESC LIMIT 300) r ON r.doc_id = id),
 s AS (SELECT doc_id AS id, ts, cosine, CASE WHEN contains(lower(file_name), 'g1') THEN 10 ELSE 0 END + CASE WHEN contains(lower(category), 'g1') THEN 5 ELSE 0 END + CASE WHEN lower(file_name) = 'g1' THEN 5 ELSE 0 END + CASE WHEN len(list_filter(tags, lambda t: contains(lower(t), 'g1'))) > 0 THEN 4 ELSE 0 END + coalesce(cosine * 100, 0) AS p, lower(text) AS t, lang FROM h LEFT JOIN n ON nid = doc_id),
 r AS (SELECT id, ts, cosine, p + CASE WHEN p = 0 AND contains(t, 'g1') THEN 3 ELSE 0 END AS score FROM s) SELECT id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, ts DESC, id) AS rank FROM r WHERE score > 0 OR cosine IS NOT NULL ORDER BY rank LIMIT 100""")
def weighted_keyword_search(spark, sf):
    """The query "g1" over the history, with the first vector's similarity for the newest rows."""
    e = table(spark, sf, "embeddings")
    near = V.scores(e, e.where("vec_id = 0").select(F.col("vec_id").alias("query"), "embedding"), None).select("id", F.col("score").alias("cosine"))
    found = S.field_search(history(spark, sf), "g1", fields={"file_name": 10, "category": 5}, exact={"file_name": 5}, lists={"tags": 4}, text_col="text", semantic=near)
    return found.select("id", six("score"), F.col("rank").cast("long").alias("rank"))


@query("autocomplete", "SELECT name, max(score) AS score FROM (SELECT p_type AS name, 1.0 AS score FROM part WHERE contains(lower(p_type), 'ar') UNION ALL SELECT p_brand, 0.9 FROM part WHERE contains(lower(p_brand), 'ar') UNION ALL SELECT n_name, 0.8 FROM nation WHERE contains(lower(n_name), 'ar')) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8")
def autocomplete(spark, sf):
    names = lambda t, c: table(spark, sf, t).select(F.col(c).alias("name"))
    return S.completions([(names("part", "p_type"), 1.0), (names("part", "p_brand"), 0.9), (names("nation", "n_name"), 0.8)], "Ar")


@query("highlight", "SELECT doc_id, string_split(regexp_replace(text, '(that|the)', chr(1) || '\\1' || chr(1), 'gi'), chr(1)) AS segments FROM documents")
def highlight(spark, sf):
    return table(spark, sf, "documents").select("doc_id", S.highlight_segments(F.col("text"), "The that a").alias("segments"))


@query("context_first_union", "SELECT doc_id, min(priority) AS priority FROM (SELECT doc_id, 0 AS priority FROM labels WHERE quality = 1 UNION ALL SELECT doc_id, 1 FROM documents WHERE lang = 'es') GROUP BY 1")
def context_first_union(spark, sf):
    first = table(spark, sf, "labels").where("quality = 1").select("doc_id").distinct()
    rest = table(spark, sf, "documents").where("lang = 'es'").select("doc_id").join(first, "doc_id", "left_anti")
    return first.withColumn("priority", F.lit(0)).unionByName(rest.withColumn("priority", F.lit(1)))


@query("rag_sources", HYBRID + "SELECT hy.query, hy.id, substring(d.text, 1, 240) AS snippet FROM hy JOIN v USING (query, id) JOIN documents d ON d.doc_id = hy.id WHERE v.score >= 0.25")
def rag_sources(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.substring("text", 1, 240).alias("snippet"))
    strong = vector(spark, sf).where("score >= 0.25").select("query", "id")
    return hybrid_results(spark, sf).join(strong, ["query", "id"]).join(d, "id").select("query", "id", "snippet")


@query("search_diagnostics", "SELECT * FROM (SELECT 'HISTORY_WITHOUT_EMBEDDINGS' AS issue, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings) UNION ALL SELECT 'DIMENSION_MISMATCH_CHUNKS', count(*) FROM embeddings WHERE vec_id % 9 = 0 UNION ALL SELECT 'EMBEDDINGS_OUT_OF_SYNC', CASE WHEN (SELECT count(*) FROM documents) > 1.5 * (SELECT count(*) FROM embeddings) THEN (SELECT count(*) FROM documents) - (SELECT count(*) FROM embeddings) ELSE 0 END UNION ALL SELECT 'STALE_BM25_INDEX', 1 UNION ALL SELECT 'LOW_CACHE_HIT_RATE', 7) WHERE n > 0")
def search_diagnostics(spark, sf):
    """Every ninth chunk lost a component, the index is older than the last change, the cache hardly helps."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    chunks = e.withColumn("embedding", F.when(F.col("id") % 9 == 0, F.slice("embedding", 1, 63)).otherwise(F.col("embedding")))
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    index = d.select(F.explode(S.tokens(F.col("text"))).alias("term"))
    return S.search_issues(e, chunks, d, index, size=64, changed=2, indexed=1, lookups=100, hits=7)


@query("contradictions", HIST + f""", n AS (SELECT b.vec_id AS query, a.vec_id AS id, row_number() OVER (PARTITION BY b.vec_id ORDER BY {COS} DESC, a.vec_id) AS rn FROM embeddings a, embeddings b WHERE b.vec_id % 50 = 0),
 s AS (SELECT query, id, unnest(list_distinct([category, 'tag' || (doc_id % 7)])) AS topic, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE ts // 864000 END AS date, lang FROM n JOIN h ON doc_id = id WHERE rn <= 10),
 p AS (SELECT x.query, x.id AS a, y.id AS b, list_sort(list(DISTINCT x.topic)) AS topics FROM s x JOIN s y ON x.query = y.query AND x.topic = y.topic AND x.id < y.id WHERE coalesce(x.date <> y.date, false) OR x.lang <> y.lang GROUP BY 1, 2, 3)
 SELECT query, a, b, topics FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY a, b) AS k FROM p) WHERE k <= 5""")
def contradictions(spark, sf):
    """Pairs among the ten sources of each query vector; every fourth source has no date."""
    h = history(spark, sf).select(F.col("doc_id").alias("vec_id"), F.array("category", F.element_at("tags", -1)).alias("topics"), F.when(F.col("doc_id") % 4 != 0, F.floor(F.col("ts") / 864000)).alias("date"), F.array("lang").alias("entities"))
    hits = V.top_k(table(spark, sf, "embeddings"), queries(spark, sf), 10).join(h, "vec_id").withColumnRenamed("vec_id", "id")
    return S.contradictions(hits)

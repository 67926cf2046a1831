"""Queries that write into a store and read what is there: search index, snapshots, stored aggregates.

Each works in a scratch folder under the shared one, which goes when its result is kept.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import history as H
from corpusloom.operators.aggregates import StoredAggregate
from corpusloom.operators.index import StoredIndex
from corpusloom.plans.history import HIST, MONTH
from corpusloom.plans.registry import query
from corpusloom.plans.search import BM, FIELDS, texts
from corpusloom.plans.vectors import six
from corpusloom.session import cut_lineage, scratch, table
from corpusloom.sources.snapshots import SnapshotStore

TOP = "SELECT query, id, round(score, 6) AS score, rank FROM b WHERE rank <= 20"
NEWEST = "fin AS (SELECT doc_id // 2 AS doc_id, max_by(text, doc_id) AS text, max_by(source, doc_id) AS source, max_by(lang, doc_id) AS lang FROM documents GROUP BY 1)"
CHANGED = "fin AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 AND doc_id % 5 <> 0 THEN substring(text, 1, 200) ELSE text END AS text, source, lang FROM documents WHERE doc_id % 11 <> 3)"
FINAL = BM.replace("FROM documents", "FROM fin")


def found(rows):
    return cut_lineage(rows.select("query", "id", six("score"), F.col("rank").cast("long").alias("rank")))


@query("index_build", f"WITH {BM}, t AS (SELECT field, id, unnest(w) AS term FROM w) SELECT field, term, count(DISTINCT id) AS df FROM t GROUP BY 1, 2")
def index_build(spark, sf):
    """Terms of a stored index with the documents that have them, all fields."""
    with scratch(spark, "index") as folder:
        index = StoredIndex(spark, folder)
        index.build(table(spark, sf, "documents"), FIELDS)
        return cut_lineage(index.term_counts())


@query("index_search", f"WITH {BM} {TOP}")
def index_search(spark, sf):
    """The rows of ``bm25_topk``, from the index."""
    with scratch(spark, "index") as folder:
        index = StoredIndex(spark, folder)
        index.build(table(spark, sf, "documents"), FIELDS)
        return found(index.search(texts(spark, sf), 20))


@query("index_newest_search", f"WITH {NEWEST}, {FINAL} {TOP}")
def index_newest_search(spark, sf):
    """Two entries a key: the newer one is indexed."""
    docs = table(spark, sf, "documents").select(F.expr("doc_id div 2").alias("doc_id"), F.col("doc_id").alias("ts"), *FIELDS)
    with scratch(spark, "index") as folder:
        index = StoredIndex(spark, folder)
        index.build(docs, FIELDS, ts="ts")
        return found(index.search(texts(spark, sf), 20))


@query("index_delta_search", f"WITH {CHANGED}, {FINAL} {TOP}")
def index_delta_search(spark, sf):
    """A fifth of the documents comes later, a seventh is changed, an eleventh is deleted."""
    docs = table(spark, sf, "documents").select("doc_id", *FIELDS)
    short = F.when((F.col("doc_id") % 7 == 0) & (F.col("doc_id") % 5 != 0), F.substring("text", 1, 200)).otherwise(F.col("text"))
    with scratch(spark, "index") as folder:
        index = StoredIndex(spark, folder)
        index.build(docs.where("doc_id % 5 <> 0"), FIELDS)
        index.apply(docs.where("doc_id % 5 = 0 OR doc_id % 7 = 0").withColumn("text", short))
        index.apply(None, docs.where("doc_id % 11 = 3").select("doc_id"))
        return found(index.search(texts(spark, sf), 20))


@query("snapshot_restore", "SELECT vec_id, label, 2 AS versions_before, 3 AS version FROM embeddings WHERE label <> 3")
def snapshot_restore(spark, sf):
    """Two versions are committed and the first is restored, without copying a row."""
    e = table(spark, sf, "embeddings").select("vec_id", "label")
    with scratch(spark, "snapshots") as folder:
        store = SnapshotStore(spark, folder)
        first = store.commit({"vectors": e.where("label <> 3")})
        store.commit({"vectors": e.where("label = 4")}, add={"more": e.where("label = 5")})
        n = len(store.versions())
        now = store.restore(first.number)
        return cut_lineage(store.read("vectors", now).select("vec_id", "label", F.lit(n).alias("versions_before"), F.lit(now.number).alias("version")))


def stored_history(spark, folder):
    month = H.month_of(F.col("ts"))
    return StoredAggregate(spark, folder, {"category": F.col("category"), "tag": F.col("tags"), "month": month, "ts": F.col("ts")}, {"bytes": F.col("size"), "confidence": F.col("confidence"), "ms": F.col("ms")}, most_segments=2)


def changed_history(spark, sf, folder):
    """Half of the history is stored; the other half comes and a third of all goes in three deltas, one of them told twice."""
    h, kept = H.history(spark, sf), stored_history(spark, folder)
    kept.rebuild(h.where("doc_id % 2 = 0"))
    kept.apply(h.where("doc_id % 2 = 1 AND doc_id % 5 < 3"), batch=0)
    kept.apply(h.where("doc_id % 2 = 1 AND doc_id % 5 < 3"), batch=0)
    kept.apply(h.where("doc_id % 2 = 1 AND doc_id % 5 >= 3"), h.where("doc_id % 6 = 0"), batch=1)
    kept.apply(None, h.where("doc_id % 6 = 3"), batch=2)
    return kept


LEFT = "WHERE doc_id % 3 <> 0"


@query("stored_statistics", HIST + f"SELECT count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes, count(DISTINCT category) AS categories, (SELECT count(DISTINCT t) FROM (SELECT unnest(tags) AS t FROM h {LEFT})) AS tags, round(avg(confidence), 6) AS avg_confidence, round(avg(ms), 6) AS avg_ms, min(ts) AS first_ts, max(ts) AS last_ts FROM h {LEFT}")
def stored_statistics(spark, sf):
    """``statistics`` of what is left, from the stored sums alone."""
    with scratch(spark, "aggregate") as folder:
        t = changed_history(spark, sf, folder).totals(distinct=("category", "tag"), span={"ts": "long"})
        mean = lambda c: F.round(F.col(c) / F.nullif(F.col("n"), F.lit(0)), 6).alias(f"avg_{c}")
        return cut_lineage(t.select("n", "bytes", F.col("category_values").alias("categories"), F.col("tag_values").alias("tags"), mean("confidence"), mean("ms"), "first_ts", "last_ts"))


@query("stored_month_counts", HIST + f"SELECT {MONTH} AS month, count(*) AS n FROM h {LEFT} GROUP BY 1")
def stored_month_counts(spark, sf):
    with scratch(spark, "aggregate") as folder:
        return cut_lineage(changed_history(spark, sf, folder).values("month").select(F.col("value").alias("month"), "n"))

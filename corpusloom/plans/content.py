"""Queries that need per-text helpers: repairs, outlines, passages, pooled chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import documents as D
from corpusloom.operators import search as S
from corpusloom.operators import vectors as V
from corpusloom.plans.registry import query
from corpusloom.plans.search import CHUNKS
from corpusloom.sources.readers import markup_text
from corpusloom.session import table


@query("repair_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_type AS kind FROM events")
def repair_json(spark, sf):
    """Props that were cut off, fenced and given a stray comma, brought back."""
    broken = F.concat(F.lit("Sure! ```json\n"), F.replace("props", F.lit("}"), F.lit(",")), F.lit('"kind": "'), "event_type", F.lit('",'))
    r = F.from_json(D.repair_json(broken), "k long, kind string")
    return table(spark, sf, "events").select("event_id", r.alias("r")).select("event_id", "r.k", "r.kind")


@query("extract_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def extract_json(spark, sf):
    noisy = F.concat(F.lit("The answer is "), "props", F.lit(" as {asked}."))
    return table(spark, sf, "events").select("event_id", F.get_json_object(D.repair_json(noisy), "$.k").cast("long").alias("k"))


@query("outline")
def outline(spark, sf):
    return table(spark, sf, "documents").select("doc_id", D.outline_of("text").alias("outline"))


@query("representative_content")
def representative_content(spark, sf):
    return table(spark, sf, "documents").select("doc_id", D.representative_content("text").alias("content"))


@query("chunk_analysis", f"WITH {CHUNKS.replace('1000', '4000').replace('800', '3800')} SELECT id, substring(string_agg(chunk, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY index), 1, 16000) AS text FROM ci WHERE index < 80 GROUP BY 1")
def chunk_analysis(spark, sf):
    """Chunks of 4,000 with overlap 200, together up to the model's budget."""
    c = S.chunks(table(spark, sf, "documents"), 4_000, 200)
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("index", "chunk"))), lambda x: x["chunk"]), "\n\n---\n\n")
    return c.groupBy("id").agg(F.substring(joined, 1, 16_000).alias("text"))


@query("chunk_mean_pool")
def chunk_mean_pool(spark, sf):
    """Texts too long for the embedder: the mean of their chunks' vectors."""
    c = S.chunks(table(spark, sf, "documents"), 700, 84, 5).select("id", D.hashing_embedder()("chunk").alias("embedding"))
    return V.centroids(c, "id").select("id", F.col("centroid").alias("embedding"))


@query("flatten_xml", r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->|<\?.*?\?>|<!\[CDATA\[|\]\]>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', chr(39)), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM pages""")
def flatten_xml(spark, sf):
    """Whole pages, read as markup."""
    return table(spark, sf, "pages").select("page_id", markup_text(F.col("html")).alias("text"))

"""The registered queries of the thirteen operators, with DuckDB SQL where it can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.centroids import cluster_vectors
from corpusloom.llm.decontaminate import decontamination_report
from corpusloom.llm.exact_dedup import exact_groups
from corpusloom.llm.extract import extract_pages
from corpusloom.llm.language_model import score_language_model
from corpusloom.llm.licences import scan_licences
from corpusloom.llm.quality import fit_quality, score_quality
from corpusloom.llm.ranked_search import ranked_search
from corpusloom.llm.sentencepieces import encode_pieces
from corpusloom.llm.sharding import shard_documents
from corpusloom.llm.simhash import near_groups
from corpusloom.llm.toxicity import fit_toxicity, score_toxicity
from corpusloom.llm.warc import fixity_drill
from corpusloom.session import cut_lineage, is_train, scratch, table


PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), 24)
    return sharded.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_pieces(docs, PIECES, fields=("n_tokens", "ids_sha256", "decoded_sha256", "n_bytes")).drop("text")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontamination_report(docs, table(spark, sf_dir, "benchmark")).drop("text_sha256")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_pages(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch(spark, "warc") as folder:
        return cut_lineage(fixity_drill(table(spark, sf_dir, "pages"), folder))


def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_language_model(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(is_train("doc_id", 5))
    model = fit_toxicity(docs, labels)
    scored = score_toxicity(docs, model)
    return scored.select("doc_id", F.coalesce(~is_train("doc_id", 5), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_hits")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(table(spark, sf_dir, "embeddings"))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels"))).drop("text")


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_decontaminate": op3_decontaminate,
    "op4_simhash": op4_simhash,
    "op5_extract": op5_extract,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_licences": op7_licences,
    "op8_warc": op8_warc,
    "op9_language_model": op9_language_model,
    "op10_toxicity": op10_toxicity,
    "op11_ranked_search": op11_ranked_search,
    "op12_centroids": op12_centroids,
    "op13_quality": op13_quality,
}
#: Words of the pattern [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z.
WORDS = r"list_filter(string_split(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' '), lambda x: x <> '')"


def _lloyd_sql(k: int = 16, rounds: int = 3) -> str:
    """The rounds of operator 12, one after another; distance and cluster are told together as distance * k + cluster."""
    parts = [
        "v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS p FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"c0 AS (SELECT row_number() OVER (ORDER BY h) - 1 AS c, p FROM (SELECT sha256('1:' || vec_id) AS h, p FROM v ORDER BY h LIMIT {k}))",
    ]
    for n in range(rounds + 1):
        far = "CAST(list_sum(list_transform(list_zip(v.p, c.p), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)"
        parts.append(f"a{n} AS (SELECT r, m % {k} AS c, m // {k} AS d FROM (SELECT r, min({far} * {k} + c) AS m FROM v, c{n} c GROUP BY r))")
        if n < rounds:
            parts.append(f"s{n} AS (SELECT c, j, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT c, unnest(p) AS x, generate_subscripts(p, 1) AS j FROM v JOIN a{n} USING (r)) GROUP BY 1, 2)")
            parts.append(f"m{n} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY j) AS p FROM s{n} GROUP BY c)")
            parts.append(f"c{n + 1} AS (SELECT c, coalesce(m.p, o.p) AS p FROM c{n} o LEFT JOIN m{n} m USING (c))")
    last = f"SELECT vec_id, CAST(c AS INT) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(o.p, ',')) AS centroid_sha256 FROM v JOIN a{rounds} USING (r) JOIN c{rounds} o USING (c)"
    return f"WITH {', '.join(parts)} {last}"


ORACLES: dict[str, str] = {
    "op11_ranked_search": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents),
        q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({WORDS}) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL),
        a AS (SELECT count(*) AS docs, CAST(sum(len(w)) AS BIGINT) AS words FROM d WHERE len(w) > 0),
        t AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
        f AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM t, a GROUP BY term, docs),
        s AS (SELECT item_id, r, doc_id, CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // words)))) AS BIGINT) AS score FROM q JOIN t USING (term) JOIN f USING (term), a GROUP BY ALL)
        SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10""",
    "op12_centroids": _lloyd_sql(),
    "op3_decontaminate": r"""
        WITH d AS (SELECT doc_id, list_filter(string_split(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM documents),
        b AS (SELECT item_id, list_filter(string_split(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM benchmark),
        bw AS (SELECT DISTINCT item_id, list_slice(w, i, i + least(len(w), 10) - 1) AS win FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)),
        lens AS (SELECT DISTINCT len(win) AS n FROM bw),
        dw AS (SELECT doc_id, i, n, list_slice(w, i, i + n - 1) AS win FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, lens WHERE len(w) >= n)),
        h AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw USING (win)),
        cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM h) GROUP BY doc_id),
        it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN it USING (doc_id)""",
    "op6_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
}

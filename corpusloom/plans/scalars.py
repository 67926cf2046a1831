"""Queries over scalar functions: text, names, lists, dates, numbers."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import search as S
from corpusloom.operators.history import history
from corpusloom.plans.history import HIST
from corpusloom.plans.registry import query
from corpusloom.session import table



def docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text")


@query("html_to_text", r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'),
 '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '[ \t\r\n]+', ' ', 'g')) AS text FROM pages""")
def html_to_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.html_text(F.col("html")).alias("text"))


MAIL = "'Subject: ' || role || chr(10) || 'From: conv' || conv_id || chr(10) || chr(10) || text"


@query("eml_headers", f"SELECT conv_id, turn, regexp_extract(m, '(?im)^Subject:\\s*(.*)$', 1) AS subject, regexp_extract(m, '(?im)^From:\\s*(.*)$', 1) AS sender, substring(m, strpos(m, chr(10) || chr(10)) + 2) AS body FROM (SELECT conv_id, turn, {MAIL} AS m FROM conversations)")
def eml_headers(spark, sf):
    m = F.concat(F.lit("Subject: "), "role", F.lit("\nFrom: conv"), F.col("conv_id").cast("string"), F.lit("\n\n"), "text")
    c = table(spark, sf, "conversations").select("conv_id", "turn", m.alias("m"))
    head = lambda name: F.regexp_extract("m", rf"(?im)^{name}:\s*(.*)$", 1)
    return c.select("conv_id", "turn", head("Subject").alias("subject"), head("From").alias("sender"), F.col("m").substr(F.instr("m", "\n\n") + 2, F.length("m")).alias("body"))


@query("clean_text", r"SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[\t\x0B\f\r]+', ' ', 'g'), '[ \n]{2,}', ' ', 'g')) AS text FROM documents")
def clean_text(spark, sf):
    return docs(spark, sf).select("doc_id", T.clean(F.col("text")).alias("text"))


@query("normalize_for_model", r"SELECT doc_id, nullif(substring(trim(regexp_replace(regexp_replace(substring(text, 1, 32000), '[\t\x0B\f\r]+', ' ', 'g'), '[ \n]{2,}', ' ', 'g')), 1, 8000), '') AS text FROM documents")
def normalize_for_model(spark, sf):
    return docs(spark, sf).select("doc_id", F.nullif(F.substring(T.clean(F.substring("text", 1, 32000)), 1, 8000), F.lit("")).alias("text"))


@query("strip_control", r"SELECT doc_id, regexp_replace(text, '[\x00-\x09\x0B\x0C\x0E-\x1F\x7F]', '', 'g') AS text FROM documents")
def strip_control(spark, sf):
    return docs(spark, sf).select("doc_id", T.strip_control(F.col("text")).alias("text"))


@query("light_clean", r"SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '\t', ' ', 'g'), ' {2,}', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g')) AS text FROM documents")
def light_clean(spark, sf):
    return docs(spark, sf).select("doc_id", T.light_clean(F.col("text")).alias("text"))


@query("split_words", r"""SELECT doc_id, list_slice(list_filter(string_split_regex(text, '[\s,.;:!?()\[\]{}"''/|-]+'), lambda w: length(w) >= 2), 1, 50) AS words FROM documents""")
def split_words(spark, sf):
    return docs(spark, sf).select("doc_id", T.split_words(F.col("text")).alias("words"))


@query("preview", "SELECT doc_id, CASE WHEN length(text) <= 100 THEN text ELSE (CASE WHEN strpos(c, ' ') > 0 AND 100 - strpos(reverse(c), ' ') > 70 THEN substring(c, 1, 100 - strpos(reverse(c), ' ')) ELSE c END) || '...' END AS preview FROM (SELECT doc_id, text, substring(text, 1, 100) AS c FROM documents)")
def preview(spark, sf):
    return docs(spark, sf).select("doc_id", T.preview(F.col("text")).alias("preview"))


@query("normalize_text", r"SELECT doc_id, substring(trim(regexp_replace(text, '[ \t\r\n]+', ' ', 'g')), 1, 500) AS text FROM documents")
def normalize_text(spark, sf):
    return docs(spark, sf).select("doc_id", T.normal_text(F.col("text"), 500).alias("text"))


@query("normalize_keywords", r"WITH w AS (SELECT doc_id, w, generate_subscripts(w, 1) AS pos, unnest(w) AS x FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]+') AS w FROM documents)), f AS (SELECT doc_id, arg_min(x, pos) AS x, min(pos) AS pos FROM w GROUP BY doc_id, lower(x)) SELECT d.doc_id, CASE WHEN text IS NULL THEN NULL ELSE coalesce(l, []) END AS keywords FROM documents d LEFT JOIN (SELECT doc_id, list(x ORDER BY pos)[1:15] AS l FROM f GROUP BY 1) k USING (doc_id)")
def normalize_keywords(spark, sf):
    w = F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), 1)
    return docs(spark, sf).select("doc_id", T.distinct_keywords(w).alias("keywords"))


LONG = "array_to_string(list_transform(range(0, 12), lambda i: category), '_')"


@query("normalize_metadata", HIST + f"SELECT doc_id, substring(file_name, 1, 255) AS name, substring({LONG}, 1, 100) AS category, substring(trim(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g')), 1, 200) AS subject, substring(trim(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g')), 1, 1000) AS summary, [lang, 'tag' || (doc_id % 7), substring({LONG} || '_x', 1, 50)] AS tags FROM h")
def normalize_metadata(spark, sf):
    long = F.array_join(F.array_repeat("category", 12), "_")
    tags = F.concat("tags", F.array(F.concat(long, F.lit("_x")), F.upper("lang"), F.lit(" ")))
    m = T.limited_metadata({"name": F.col("file_name"), "category": long, "subject": F.col("text"), "summary": F.col("text"), "tags": tags})
    return history(spark, sf).select("doc_id", *(c.alias(name) for name, c in m.items()))


@query("case_conventions", "WITH w AS (SELECT p_partkey, list_filter(string_split_regex(lower(replace(p_name, ' ', ' é')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM part), t AS (SELECT p_partkey, w, array_to_string(list_transform(w, lambda x: upper(x[1]) || x[2:]), '') AS pascal FROM w) SELECT p_partkey, array_to_string(w, '-') AS kebab, array_to_string(w, '_') AS snake, pascal, lower(pascal[1]) || pascal[2:] AS camel, array_to_string(w, ' ') AS lower, upper(array_to_string(w, ' ')) AS upper FROM t")
def case_conventions(spark, sf):
    n = F.replace("p_name", F.lit(" "), F.lit(" é"))
    return table(spark, sf, "part").select("p_partkey", *(T.case_convention(n, k).alias(k) for k in ("kebab", "snake", "pascal", "camel", "lower", "upper")))


@query("suggested_name", HIST + """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN category || '-' || d || '.' || ext WHEN 1 THEN d || '-' || category || '.' || ext WHEN 2 THEN lang || '-' || category || '-' || d || '.' || ext WHEN 3 THEN 'tag' || (doc_id % 7) || '-' || category || '.' || ext ELSE file_name END AS name FROM (SELECT *, strftime(make_timestamp(ts * 1000000), '%Y-%m-%d') AS d FROM h)""")
def suggested_name(spark, sf):
    kinds = F.array(*map(F.lit, (*T.NAME_TEMPLATES, "keep", "no such template")))
    values = {"subject": F.col("category"), "date": F.date_format(F.timestamp_seconds("ts"), "yyyy-MM-dd"), "project": F.col("lang"), "category": F.element_at("tags", -1)}
    return history(spark, sf).select("doc_id", T.suggested_name(F.get(kinds, F.col("doc_id") % 6), F.col("file_name"), values).alias("name"))

@query("strategy_path", HIST + "SELECT doc_id, 'Projects/' || category || '/' || ext || '/' || strftime(make_timestamp(ts * 1000000), '%Y') AS path FROM h")
def strategy_path(spark, sf):
    path = F.lit("Projects/{project_name}/{file_type}/{year}")
    for slot, value in (("project_name", F.col("category")), ("file_type", F.col("ext")), ("year", F.date_format(F.timestamp_seconds("ts"), "yyyy"))):
        at = F.instr(path, "{" + slot + "}")
        path = F.overlay(path, value, at, F.lit(len(slot) + 2))
    return history(spark, sf).select("doc_id", path.alias("path"))


@query("file_type_category", HIST + "SELECT doc_id, CASE ext WHEN 'csv' THEN 'Spreadsheets' WHEN 'png' THEN 'Images' ELSE 'Documents' END AS type FROM h")
def file_type_category(spark, sf):
    return history(spark, sf).select("doc_id", T.type_group(F.col("ext")).alias("type"))


@query("file_name_parts", HIST + "SELECT doc_id, regexp_extract(path, '([^/]+)$', 1) AS name, regexp_extract(path, '([^/]+)\\.[^./]*$', 1) AS stem, lower(regexp_extract(path, '(\\.[^./]*)$', 1)) AS ext FROM h")
def file_name_parts(spark, sf):
    return history(spark, sf).select("doc_id", T.base_name(F.col("path")).alias("name"), F.regexp_extract("path", r"([^/]+)\.[^./]*$", 1).alias("stem"), T.extension_of(T.base_name(F.col("path"))).alias("ext"))


@query("fitted_names", """WITH n AS (SELECT doc_id, CASE WHEN doc_id % 5 = 4 THEN ' ' ELSE trim(regexp_replace(substring(text, 1, 1 + doc_id % 90), '[\\s./]+', ' ', 'g')) || '.pdf' END AS raw FROM documents), m AS (SELECT doc_id, CASE WHEN trim(raw) = '' THEN 'unnamed' ELSE trim(raw) END AS name FROM n),
 c AS (SELECT doc_id, name, substring(name, 1, 35) AS cut FROM m), d AS (SELECT doc_id, name, cut, length(regexp_extract(cut, '^(.*)[ _-][^ _-]*$', 1)) AS pos FROM c) SELECT doc_id, CASE WHEN length(name) <= 40 THEN name ELSE trim(CASE WHEN pos > 17.5 THEN substring(cut, 1, pos) ELSE cut END) || '.pdf' END AS name FROM d""")
def fitted_names(spark, sf):
    """Names of 40 characters at most, cut between words where that leaves enough of them."""
    raw = F.concat(F.trim(F.regexp_replace(F.substring("text", F.lit(1), (1 + F.col("doc_id") % 90).cast("int")), r"[\s./]+", " ")), F.lit(".pdf"))
    return docs(spark, sf).select("doc_id", T.fitted_name(F.when(F.col("doc_id") % 5 == 4, " ").otherwise(raw), 40).alias("name"))


@query("supported_extensions", "WITH e AS (SELECT event_id, ['.PDF', 'png', 'mp3', 'exe', 'log', 'stl', ''][1 + event_id % 7] AS ext FROM events) SELECT event_id, ext IN ('.PDF') AS document, ext IN ('.PDF', 'png', 'log') AS analysed, ext NOT IN ('exe', '') AS supported FROM e")
def supported_extensions(spark, sf):
    ext = F.get(F.array(*map(F.lit, (".PDF", "png", "mp3", "exe", "log", "stl", ""))), (F.col("event_id") % 7).cast("int"))
    return table(spark, sf, "events").select("event_id", T.is_supported(ext, "document").alias("document"), T.is_supported(ext, "analysed").alias("analysed"), T.is_supported(ext, "all").alias("supported"))


@query("classify_error", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'TIMEOUT' WHEN event_id % 5 = 1 THEN 'NETWORK' WHEN event_id % 5 = 2 THEN 'AI_ENGINE_ERROR' ELSE 'UNKNOWN' END AS kind, event_id % 5 < 3 AS retryable FROM events WHERE event_type = 'error'")
def classify_error(spark, sf):
    message = F.element_at(F.array(*map(F.lit, ("Request TIMEOUT on network", "network down", "model crashed", "odd", "???"))), (F.col("event_id") % 5 + 1).cast("int"))
    e = table(spark, sf, "events").where("event_type = 'error'").select("event_id", T.error_kind(message).alias("kind"))
    return e.withColumn("retryable", F.col("kind").isin("TIMEOUT", "NETWORK", "AI_ENGINE_ERROR"))


@query("coerce_list", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN [event_type, 'x'] ELSE [event_type, 'y', 'z'] END AS items FROM events")
def coerce_list(spark, sf):
    raw = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('["'), "event_type", F.lit('", " x ", ""]'))).otherwise(F.concat("event_type", F.lit(", y,, z")))
    return table(spark, sf, "events").select("event_id", T.as_list(raw).alias("items"))


ANSWERS = """CASE event_id % 6 WHEN 0 THEN '{"category": "' || event_type || '", "confidence": ' || value || ', "keywords": ["a", 1, "", null, "' || event_type || '"]}' WHEN 1 THEN '{"category": 7, "confidence": "90"}' WHEN 2 THEN '{"category": "  ", "keywords": "one"}' WHEN 3 THEN '{"confidence": ' || (value + 60) || '}' WHEN 4 THEN 'no json' ELSE '[1, 2]' END"""


@query("validate_analysis", f"WITH a AS (SELECT event_id, event_type, value, {ANSWERS} AS j FROM events) SELECT event_id, CASE WHEN event_id % 6 = 0 THEN event_type ELSE 'document' END AS category, CASE WHEN event_id % 6 = 0 THEN ['a', event_type] ELSE [] END AS keywords, CASE WHEN event_id % 6 = 0 AND value BETWEEN 0 AND 100 THEN value WHEN event_id % 6 = 3 AND value + 60 BETWEEN 0 AND 100 THEN round(value + 60, 6) ELSE 70.0 END AS confidence FROM a WHERE value IS NOT NULL")
def validate_analysis(spark, sf):
    """Answers with numbers for texts, texts for numbers, blanks, and what is no object at all."""
    e = table(spark, sf, "events").where("value IS NOT NULL")
    j = F.element_at(F.array(
        F.concat(F.lit('{"category": "'), "event_type", F.lit('", "confidence": '), F.col("value").cast("string"), F.lit(', "keywords": ["a", 1, "", null, "'), "event_type", F.lit('"]}')),
        F.lit('{"category": 7, "confidence": "90"}'), F.lit('{"category": "  ", "keywords": "one"}'), F.concat(F.lit('{"confidence": '), (F.col("value") + 60).cast("string"), F.lit("}")), F.lit("no json"), F.lit("[1, 2]"),
    ), (F.col("event_id") % 6 + 1).cast("int"))
    a = e.select("event_id", T.validated_analysis(j).alias("a"))
    return a.select("event_id", "a.category", "a.keywords", F.round("a.confidence", 6).alias("confidence"))


@query("json_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("date_formats", "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 1 THEN strftime(o_orderdate, '%m-%d-%Y') WHEN 2 THEN strftime(o_orderdate, '%d-%m-%Y') WHEN 3 THEN strftime(o_orderdate, '%Y%m%d') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders")
def date_formats(spark, sf):
    """The four styles, and one that nobody knows."""
    style = F.get(F.array(*map(F.lit, (*T.DATE_FORMATS, "week"))), (F.col("o_orderkey") % 5).cast("int"))
    return table(spark, sf, "orders").select("o_orderkey", T.formatted_date(F.col("o_orderdate"), style).alias("day"))


@query("parse_ts", "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(floor(epoch_us(ts) / 1000.0) AS BIGINT) END AS ms FROM events")
def parse_ts(spark, sf):
    raw = F.when(F.col("event_id") % 7 == 0, F.lit("soon")).otherwise(F.col("ts").cast("string"))
    return table(spark, sf, "events").select("event_id", F.unix_millis(F.try_to_timestamp(raw)).alias("ms"))


@query("effective_date", HIST + "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '2024-03-05' WHEN 1 THEN '2023-11-30' WHEN 2 THEN strftime(make_timestamp(ts * 1000000), '%Y-%m-%d') ELSE '2020-02-02' END AS day, CASE WHEN doc_id % 4 = 1 THEN 'scan' ELSE category END AS subject FROM h")
def effective_date(spark, sf):
    """A date in the name, else when the file was changed, else when it was made; and subjects without it."""
    k = F.col("doc_id") % 4
    name = F.when(k == 0, F.concat(F.lit("2024-03-05 "), "file_name")).when(k == 1, F.concat(F.lit("scan_20231130_"), "category")).otherwise(F.col("category"))
    day = T.effective_date(name, F.when(k == 2, F.timestamp_seconds("ts")), F.lit("2020-02-02").cast("timestamp"))
    subject = F.when(k == 0, F.concat("category", F.lit(" - 2024-03-05"))).when(k == 1, "scan_20231130 2023-11-30").otherwise(F.col("category"))
    return history(spark, sf).select("doc_id", F.date_format(day, "yyyy-MM-dd").alias("day"), T.without_date(subject).alias("subject"))


@query("normalize_confidence", "SELECT event_id, greatest(0.0, least(100.0, round(CASE WHEN value <= 1 THEN value * 100 ELSE value END))) AS confidence FROM events")
def normalize_confidence(spark, sf):
    return table(spark, sf, "events").select("event_id", T.percent(F.col("value")).alias("confidence"))


@query("derived_confidence", HIST + "SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND (confidence <> 0 OR doc_id % 2 = 0) THEN CASE WHEN confidence <= 1 THEN confidence * 100.0 ELSE confidence END WHEN doc_id % 3 < 2 AND ms <= 400 THEN round(30 + 40 * ms / 400.0) WHEN doc_id % 3 < 2 THEN round(least(70.0, ms / 400.0)) ELSE 35.0 + 5 * (CASE WHEN lang = 'en' THEN 1 ELSE 0 END + CASE WHEN size > 900 THEN 1 ELSE 0 END) END AS confidence FROM h")
def derived_confidence(spark, sf):
    h = history(spark, sf)
    said = F.when(F.col("doc_id") % 3 == 0, F.col("confidence").cast("double"))
    near = F.when(F.col("doc_id") % 3 < 2, F.col("ms") / 400)
    return h.select("doc_id", T.derived_confidence(said, F.col("doc_id") % 2 == 0, near, [F.col("lang") == "en", F.col("size") > 900]).alias("confidence"))

@query("semver_compare", "WITH v AS (SELECT p_partkey, [p_partkey % 3, p_partkey % 11, p_size] AS a, [1, 5, 20] AS b FROM part) SELECT p_partkey, CASE WHEN a[1] <> b[1] THEN sign(a[1] - b[1]) WHEN a[2] <> b[2] THEN sign(a[2] - b[2]) ELSE sign(a[3] - b[3]) END AS cmp FROM v")
def semver_compare(spark, sf):
    v = F.concat_ws(".", (F.col("p_partkey") % 3).cast("string"), (F.col("p_partkey") % 11).cast("string"), F.col("p_size").cast("string"))
    a, b = T.version_key(v), T.version_key(F.lit("1.5.20"))
    first = F.coalesce(F.get(F.filter(F.zip_with(a, b, lambda x, y: F.signum((x - y).cast("double"))), lambda s: s != 0), F.lit(0)), F.lit(0.0))
    return table(spark, sf, "part").select("p_partkey", first.cast("int").alias("cmp"))


@query("backoff", "SELECT event_id, least(60000.0, 5000.0 * power(2.0, event_id % 6)) AS wait_ms FROM events")
def backoff(spark, sf):
    return table(spark, sf, "events").select("event_id", T.backoff(F.col("event_id") % 6 + 1).alias("wait_ms"))


@query("jaccard_keywords", "WITH w AS (SELECT p_partkey, list_distinct(string_split(p_name, ' ')) AS a, list_distinct(string_split(p_type, ' ')) AS b FROM part) SELECT p_partkey, round(len(list_intersect(a, b)) * 1.0 / len(list_distinct(list_concat(a, b))), 6) AS score FROM w")
def jaccard_keywords(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.round(T.jaccard(F.split("p_name", " "), F.split("p_type", " ")), 6).alias("score"))


@query("word_overlap", "WITH w AS (SELECT p_partkey, list_distinct(string_split(lower(p_name), ' ')) AS a, list_distinct(string_split(lower(p_brand || ' ' || p_name), ' ')) AS b FROM part) SELECT p_partkey, round(len(list_intersect(a, b)) * 1.0 / greatest(len(a), len(b)), 6) AS score FROM w")
def word_overlap(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.round(T.overlap(F.split(F.lower("p_name"), " "), F.split(F.lower(F.concat_ws(" ", "p_brand", "p_name")), " ")), 6).alias("score"))


@query("content_hash", HIST + "SELECT doc_id, substring(sha256(path || ':' || size || ':' || ts), 1, 16) AS file_hash, 'folder:' || substring(sha256(category || '|/' || category || '|'), 1, 32) AS folder_id, sha256(text) AS content_hash FROM h")
def content_hash(spark, sf):
    return history(spark, sf).select("doc_id", F.substring(F.sha2(F.concat_ws(":", "path", F.col("size").cast("string"), F.col("ts").cast("string")), 256), 1, 16).alias("file_hash"), F.concat(F.lit("folder:"), F.substring(F.sha2(F.concat("category", F.lit("|/"), "category", F.lit("|")), 256), 1, 32)).alias("folder_id"), F.sha2("text", 256).alias("content_hash"))


@query("extract_year", "SELECT doc_id, list_extract(y, -1) AS year FROM (SELECT doc_id, regexp_extract_all(text || ' ' || (1990 + doc_id % 40), '\\b((?:19|20)\\d{2})\\b', 1) AS y FROM documents)")
def extract_year(spark, sf):
    y = F.regexp_extract_all(F.concat("text", F.lit(" "), (F.lit(1990) + F.col("doc_id") % 40).cast("string")), F.lit(r"\b((?:19|20)\d{2})\b"), 1)
    return docs(spark, sf).select("doc_id", F.element_at(y, -1).alias("year"))


@query("tokenize", r"SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}]+(?:[''’-][\p{L}\p{N}]+)*'), lambda w: length(w) > 1) AS tokens FROM documents")
def tokenize(spark, sf):
    t = F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}]+(?:['’-][\p{L}\p{N}]+)*)"), 1)
    return docs(spark, sf).select("doc_id", F.filter(t, lambda w: F.length(w) > 1).alias("tokens"))


VOCAB = "v AS (SELECT DISTINCT lower(w) AS word FROM (SELECT unnest(string_split_regex(p_name, '[^A-Za-z]+')) AS w FROM part) WHERE length(w) BETWEEN 5 AND 19 UNION SELECT DISTINCT lower(trim(p_type)) FROM part WHERE length(trim(p_type)) >= 5)"


def vocabulary_of(spark, sf):
    p = table(spark, sf, "part")
    return S.vocabulary(p.select(F.col("p_type").alias("word")), p.select(F.col("p_name").alias("text")))


@query("vocabulary", f"WITH {VOCAB} SELECT word FROM v")
def vocabulary(spark, sf):
    return vocabulary_of(spark, sf)


@query("spell_correct", f"WITH {VOCAB}, t AS (SELECT DISTINCT word[1:2] || word[4:] AS typo FROM v UNION SELECT 'this' UNION SELECT 'which' UNION SELECT min(word) FROM v), d AS (SELECT word, row_number() OVER (ORDER BY word DESC) AS place FROM v), c AS (SELECT t.typo, d.word AS fixed, row_number() OVER (PARTITION BY t.typo ORDER BY d.place) AS rn FROM t JOIN d ON abs(length(d.word) - length(t.typo)) <= 1 AND levenshtein(t.typo, d.word) = 1 WHERE length(t.typo) >= 5 AND t.typo NOT IN (SELECT word FROM v) AND t.typo <> 'which') SELECT typo, coalesce(fixed, typo) AS fixed FROM t LEFT JOIN (SELECT * FROM c WHERE rn = 1) USING (typo)")
def spell_correct(spark, sf):
    """Typos lack a letter; two stop words and a known word stay. The dictionary's order is the alphabet's, from its end."""
    v = vocabulary_of(spark, sf)
    typos = v.select(F.concat(F.substring("word", 1, 2), F.col("word").substr(F.lit(4), F.length("word"))).alias("word")).unionByName(spark.createDataFrame([("this",), ("which",)], "word string")).unionByName(v.agg(F.min("word").alias("word"))).distinct()
    known = v.withColumn("place", F.row_number().over(W.orderBy(F.desc("word"))))  # a dictionary of words
    return S.spelling(typos, known, stop=("this", "which"), phonetic_from=None).select(F.col("word").alias("typo"), "fixed")


@query("levenshtein_pairs", "SELECT a.n_name AS a, b.n_name AS b, CAST(levenshtein(a.n_name, b.n_name) AS INT) AS distance FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def levenshtein_pairs(spark, sf):
    n = table(spark, sf, "nation")
    pairs = n.alias("a").join(n.alias("b"), "n_regionkey").where("a.n_nationkey < b.n_nationkey")
    return pairs.select(F.col("a.n_name").alias("a"), F.col("b.n_name").alias("b"), F.levenshtein("a.n_name", "b.n_name").alias("distance"))


#: A word's code: digits of all letters but the first, those that follow themselves once, others (0) left out, three of them.
CODED = """SELECT word, upper(word[1]) || rpad(substring(array_to_string(list_transform(list_filter(range(1, length(c) + 1), lambda i: c[i] <> '0' AND (i = 1 OR c[i - 1] <> c[i])), lambda i: c[i]), ''), 1, 3), 3, '0') AS code
 FROM (SELECT word, translate(word[2:], 'abcdefghijklmnopqrstuvwxyz', '01230120022455012623010202') AS c FROM {})"""
NAMES = "n AS (SELECT DISTINCT lower(w) AS word FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]{5,9}')) AS w FROM documents))"


@query("phonetic_code", f"WITH {NAMES} {CODED.format('n')}")
def phonetic_code(spark, sf):
    names = docs(spark, sf).select(F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]{5,9})"), 1)).alias("word")).select(F.lower("word").alias("word")).distinct()
    return names.select("word", T.phonetic_code("word").alias("code"))


@query("phonetic_match", f"WITH {NAMES}, a AS ({CODED.format('n')}) SELECT word, other FROM (SELECT a.word, b.word AS other, row_number() OVER (PARTITION BY a.word ORDER BY abs(length(a.word) - length(b.word)), b.word) AS rn FROM a JOIN a b USING (code) WHERE a.word <> b.word) WHERE rn = 1")
def phonetic_match(spark, sf):
    """Of the words with the same code the one nearest in length, the first of equals."""
    return S.sound_alikes(phonetic_code(spark, sf))


@query("semantic_terms", "SELECT doc_id, list_distinct_sorted AS terms FROM (SELECT doc_id, list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: length(w) >= 4 AND NOT regexp_full_match(w, '[0-9]+') AND NOT list_contains(['that', 'this', 'with', 'from'], w)))) AS list_distinct_sorted FROM documents)")
def semantic_terms(spark, sf):
    return docs(spark, sf).select("doc_id", T.semantic_terms(F.col("text")).alias("terms"))

@query("token_budget", "SELECT doc_id, CAST(ceil(length(text) / 3.5) AS BIGINT) AS tokens, length(text) / 3.5 > floor(0.85 * 512) AS over, length(substring(text, 1, CAST(floor(floor(0.85 * 512) * 3.5) AS BIGINT))) AS kept FROM documents")
def token_budget(spark, sf):
    budget = int(0.85 * 512)
    return docs(spark, sf).select("doc_id", T.estimated_tokens(F.col("text")).cast("long").alias("tokens"), (F.length("text") / 3.5 > budget).alias("over"), F.length(F.substring("text", 1, int(budget * 3.5))).cast("long").alias("kept"))


@query("query_intent", r"SELECT conv_id, turn, length(text) <= 100 AND regexp_matches(lower(trim(text)), '^(hi|hello|thanks|the|is)\b') AS conversational, length(text) <= 300 AND regexp_matches(lower(trim(text)), '\b(compare|versus|vs|than|differ)\b') AS comparison, length(text) <= 300 AND regexp_matches(lower(trim(text)), '\b(missing|gap|lack)\b') AS gap, length(text) <= 300 AND regexp_matches(lower(trim(text)), '\b(all|overall|every)\b') AS holistic, length(text) <= 200 AND regexp_matches(lower(trim(text)), '^(no|actually|not that|at)\b') AS correction FROM conversations")
def query_intent(spark, sf):
    """Phrases are the caller's; these are enough for the test tables."""
    t = F.col("text")
    return table(spark, sf, "conversations").select("conv_id", "turn", T.any_phrase(t, ("hi", "hello", "thanks", "the", "is"), 100, at_start=True).alias("conversational"), T.any_phrase(t, ("compare", "versus", "vs", "than", "differ"), 300).alias("comparison"), T.any_phrase(t, ("missing", "gap", "lack"), 300).alias("gap"), T.any_phrase(t, ("all", "overall", "every"), 300).alias("holistic"), T.any_phrase(t, ("no", "actually", "not that", "at"), 200, at_start=True).alias("correction"))

@query("embedding_summary", HIST + "SELECT doc_id, substring(concat_ws(chr(10), category, array_to_string(tags, ', '), file_name, nullif(substring(text, 1, 2000), '')), 1, 4000) AS summary FROM h")
def embedding_summary(spark, sf):
    fields = [F.col("category"), F.array_join("tags", ", "), F.lit(" "), F.col("file_name")]
    return history(spark, sf).select("doc_id", T.summary_text(fields, F.col("text")).alias("summary"))


CONCEPTS = {"pdf": ["document"], "docx": ["document", "letter"], "csv": ["table"], "png": ["picture"]}


@query("extension_concept_score", HIST + ", m AS (SELECT * FROM (VALUES ('pdf', 'document'), ('docx', 'document'), ('docx', 'letter'), ('csv', 'table'), ('png', 'picture')) t(ext, concept)) SELECT doc_id, concept, least(20, 10 + length(concept)) AS score FROM h JOIN m USING (ext)")
def extension_concept_score(spark, sf):
    m = spark.createDataFrame([(e, c) for e, words in CONCEPTS.items() for c in words], "ext string, concept string")
    return history(spark, sf).join(F.broadcast(m), "ext").select("doc_id", "concept", T.concept_score(F.col("concept")).cast("long").alias("score"))


@query("enriched_text", HIST + "SELECT doc_id, CASE WHEN ext = 'docx' THEN category || ' ' || CASE WHEN doc_id % 2 = 0 THEN 'letter' ELSE 'document letter' END WHEN ext = 'pdf' AND doc_id % 2 = 1 THEN category || ' document' WHEN ext = 'csv' THEN category || ' table' WHEN ext = 'png' THEN category || ' picture' ELSE category END AS text FROM (SELECT doc_id, ext, category || CASE WHEN doc_id % 2 = 0 THEN ' My Document' ELSE '' END AS category FROM h)")
def enriched_text(spark, sf):
    text = F.concat("category", F.when(F.col("doc_id") % 2 == 0, " My Document").otherwise(""))
    return history(spark, sf).select("doc_id", T.with_concepts(text, F.col("ext"), CONCEPTS).alias("text"))

"""Text search: BM25 postings, score fusion, hybrid search, re-ranking, graph expansion."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import phonetic_code
from corpusloom.operators.vectors import Running, top_k
from corpusloom.session import cut_lineage, small_batches

K1, B = 1.2, 0.75
RRF = 60
SOME = 512  # documents scored at a time, or fewer with so many
POINTS = 500_000  # points of a document's term for a query


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]{2,})"), 1)


def postings(docs: DataFrame, fields: dict[str, float], *, id_col: str = "doc_id", terms: DataFrame | None = None) -> DataFrame:
    """(field, boost, id, term, tf, length). With ``terms`` (term) only their postings; lengths count all tokens."""
    rows = None
    for field, boost in fields.items():
        one = docs.select(F.lit(field).alias("field"), F.lit(boost).alias("boost"), F.col(id_col).alias("id"), tokens(F.col(field)).alias("w"))
        rows = one if rows is None else rows.unionByName(one)
    rows = rows.select("field", "boost", "id", F.size("w").alias("length"), F.explode("w").alias("term"))
    if terms is not None:
        rows = rows.join(terms, "term", "left_semi")
    return rows.groupBy("field", "boost", "id", "term", "length").agg(F.count("*").alias("tf"))


_PLAIN = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def _tokens(text: str | None) -> list[bytes]:
    """What ``tokens`` gives, as bytes."""
    return [w for w in (text or "").lower().encode().translate(_PLAIN).split() if len(w) > 1]


def bm25(docs: DataFrame, queries: DataFrame, fields: dict[str, float], *, id_col: str = "doc_id", k: int, max_terms: int = 500_000) -> DataFrame:
    """(query, id, score, rank): the first k by the boosted sum of per-field BM25 scores for each query (query, text).

    The terms of the queries (counted first; up to ``max_terms`` go to the tasks) are all
    that is counted: one pass over the texts writes lengths and counts of those terms. Numbers
    of documents come from there, one row a field and term at most, and then each document is
    scored against all queries that share a term with it; a task sends on k rows a query. More
    terms than that are joined instead. A null field has no length and no terms, but counts as
    a document; ids are unique.
    """
    q = queries.select("query", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")).distinct()
    known = q.limit(max_terms + 1).collect()
    if len(known) > max_terms:
        out = _bm25_joined(docs, q, fields, id_col)
    else:
        out = _bm25_in_tasks(docs, [(r["query"], r["term"].encode()) for r in known], fields, id_col, k)
    out = out.withColumn("score", F.round("score", 9))  # sums of equal texts stay equal
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)


def _bm25_in_tasks(docs: DataFrame, known: list[tuple[int, bytes]], fields: dict[str, float], id_col: str, k: int) -> DataFrame:
    spark, names = docs.sparkSession, list(fields)
    small_batches(spark)
    asked, terms = sorted({q for q, _ in known}), sorted({t for _, t in known})
    at, number = {q: n for n, q in enumerate(asked)}, {t: n for n, t in enumerate(terms)}
    listed: list[list[int]] = [[] for _ in terms]
    for q, term in known:
        listed[number[term]].append(at[q])
    numbers = spark.sparkContext.broadcast(number)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get = numbers.value.get
        for batch in batches:
            for n in range(len(names)):
                words = [_tokens(text) for text in batch[f"f{n}"]]
                found = [Counter([t for t in map(get, w) if t is not None]) for w in words]
                yield pd.DataFrame({"id": batch["id"], "field": n, "size": [None if text is None else len(w) for text, w in zip(batch[f"f{n}"], words, strict=True)], "terms": [list(c) for c in found], "tf": [list(c.values()) for c in found]})

    rows = docs.select(F.col(id_col).alias("id"), *(F.col(f).cast("string").alias(f"f{n}") for n, f in enumerate(names)))
    counted = cut_lineage(rows.mapInPandas(count, "id long, field int, size double, terms array<int>, tf array<int>"))
    total = {r["field"]: (r["docs"], r["mean"] or 1e-9) for r in counted.groupBy("field").agg(F.count("*").alias("docs"), F.avg("size").alias("mean")).collect()}
    idf = np.zeros((len(names), len(terms)))
    for r in counted.select("field", F.explode("terms").alias("term")).groupBy("field", "term").agg(F.count("*").alias("df")).collect():  # a row a field and term at most
        idf[r["field"], r["term"]] = fields[names[r["field"]]] * math.log(1 + (total[r["field"]][0] - r["df"] + 0.5) / (r["df"] + 0.5))
    means = [total.get(n, (0, 1.0))[1] for n in range(len(names))]
    sent = spark.sparkContext.broadcast((idf, [np.array(x, dtype=np.int32) for x in listed]))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        idf, lists = sent.value
        lengths = np.array([len(x) for x in lists])
        listed, first = np.concatenate([np.zeros(0, dtype=np.int32), *lists]), np.cumsum(lengths) - lengths
        names, running = np.array(asked, dtype=np.int64), Running(np.array(asked, dtype=np.int64), k)
        for batch in batches:
            for a in range(0, len(batch), SOME):
                some = batch.iloc[a : a + SOME]
                doc, term, points = [], [], []
                for n, per_field in enumerate(some["parts"]):
                    for part in per_field:
                        at, tf = np.asarray(part["terms"]), np.asarray(part["tf"], dtype=float)
                        if len(at):
                            base = K1 * (1 - B + B * part["size"] / means[part["field"]])
                            doc.append(np.full(len(at), n))
                            term.append(at)
                            points.append(idf[part["field"], at] * tf * (K1 + 1) / (tf + base))
                if not doc:
                    continue
                doc, term, points = np.concatenate(doc), np.concatenate(term), np.concatenate(points)
                # One row for every query that has a term of a document, added up by query and document: no row for others.
                of_doc = np.cumsum(np.bincount(doc, lengths[term], minlength=len(some))) // POINTS  # documents stand in order
                for part in np.split(np.arange(len(doc)), np.flatnonzero(np.diff(of_doc[doc])) + 1):
                    d, t, p = doc[part], term[part], points[part]
                    times = lengths[t]
                    query = listed[np.repeat(first[t], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)]
                    pair = query.astype(np.int64) * len(some) + np.repeat(d, times)
                    order = np.argsort(pair, kind="stable")
                    pair, starts = np.unique(pair[order], return_index=True)
                    if not len(pair):
                        continue
                    score = np.add.reduceat(np.repeat(p, times)[order], starts).round(9)
                    query, d = pair // len(some), pair % len(some)
                    keep = (score > 0) & (score >= running.edge[query])  # all that tie with the k-th stay
                    running.add(pd.DataFrame({"query": names[query[keep]], "id": some["id"].to_numpy()[d[keep]], "score": score[keep]}))
        if (kept := running.cut()) is not None:
            yield kept

    # The fields of a document meet in one row; what is shuffled are the counts of the queries' terms alone.
    by_doc = counted.where(F.size("terms") > 0).groupBy("id").agg(F.collect_list(F.struct("field", "size", "terms", "tf")).alias("parts"))
    return by_doc.mapInPandas(score, "query long, id long, score double")


def _bm25_joined(docs: DataFrame, q: DataFrame, fields: dict[str, float], id_col: str) -> DataFrame:
    p = postings(docs, fields, id_col=id_col, terms=q.select("term").distinct())
    stats = None
    for field in fields:
        one = docs.select(F.lit(field).alias("field"), F.size(tokens(F.col(field))).alias("n")).groupBy("field").agg(F.count("*").alias("docs"), F.avg("n").alias("mean"))
        stats = one if stats is None else stats.unionByName(one)
    df = p.groupBy("field", "term").agg(F.count("*").alias("df"))
    s = p.join(df, ["field", "term"]).join(stats, "field")
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    s = s.select("id", "term", (F.col("boost") * idf * weight).alias("s"))
    return q.join(s, "term").groupBy("query", "id").agg(F.sum("s").alias("score"))


def normalised(df: DataFrame, score: str = "score", by: str = "query") -> DataFrame:
    """Min-max within each query's result; a constant result is clamped to [0, 1]."""
    w = Window.partitionBy(by)
    low, high = F.min(score).over(w), F.max(score).over(w)
    flat = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(score)))
    return df.withColumn(score, F.when(high > low, (F.col(score) - low) / (high - low)).otherwise(flat))


def fuse(parts: dict[str, tuple[DataFrame, float]]) -> DataFrame:
    """(query, id, score): weighted sum of results given as (query, id, score); absent counts as 0. One shuffle."""
    rows = None
    for df, weight in parts.values():
        one = df.select("query", "id", (F.col("score") * weight).alias("s"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy("query", "id").agg(F.round(F.sum("s"), 9).alias("score"))


def hybrid(text: DataFrame, vector: DataFrame, chunk: DataFrame, *, k: int = 30, keyword_weight: float = 0.25, chunk_weight: float = 0.5, min_score: float = 0.15) -> DataFrame:
    """Weighted sum of the normalised results, its first k, and of these what reaches ``min_score``: in this order."""
    gamma = (1 - keyword_weight) * min(max(chunk_weight, 0.0), 1.0)
    fused = fuse({"text": (normalised(text), keyword_weight), "vector": (normalised(vector), 1 - keyword_weight - gamma), "chunk": (normalised(chunk), gamma)})
    ranked = fused.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id")))
    return ranked.where(F.col("rank") <= k).where(F.col("score") >= min_score)


def reciprocal_rank_fusion(parts: list[DataFrame], *, blend: float = 0.7) -> DataFrame:
    """(query, id, score): reciprocal ranks over their maximum, blended with the best normalised score."""
    rows = None
    for df in parts:
        one = normalised(df).select("query", "id", (1.0 / (RRF + F.col("rank"))).alias("r"), "score")
        rows = one if rows is None else rows.unionByName(one)
    s = rows.groupBy("query", "id").agg(F.sum("r").alias("r"), F.max("score").alias("best"))
    top = F.greatest(F.max("r").over(Window.partitionBy("query")), F.lit(0.001))
    return s.select("query", "id", (blend * F.col("r") / top + (1 - blend) * F.col("best")).alias("score"))


def rerank(results: DataFrame, points: Column, n: int = 10) -> DataFrame:
    """The first n by points (0 to 10, missing 5) and their old rank, the others after them as they were."""
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(points, F.lit(5.0)) / 10))
    r = results.withColumn("points", F.when(F.col("rank") <= n, score))
    order = Window.partitionBy("query").orderBy(F.col("points").isNull(), F.desc("points"), "rank")
    return r.withColumn("new_rank", F.row_number().over(order))


def graph_expand(results: DataFrame, edges: DataFrame, *, seeds: int = 15, damping: float = 0.6, weight: float = 0.2, top: int = 120) -> DataFrame:
    """Neighbours of the first results get a share of their seed's score; rows that are new may come in."""
    s = results.where(F.col("rank") <= seeds).select("query", "id", "score")
    both = edges.select(F.col("source").alias("id"), F.col("target").alias("other"), "weight").unionByName(edges.select(F.col("target").alias("id"), F.col("source").alias("other"), "weight"))
    heaviest = edges.select(F.max("weight")).scalar()
    near = s.join(both, "id").select("query", F.col("other").alias("id"), (F.col("score") * F.least(F.lit(1.0), F.col("weight") / heaviest) * damping).alias("n"))
    near = near.join(s.select("query", "id"), ["query", "id"], "left_anti").groupBy("query", "id").agg(F.max("n").alias("n"))
    near = near.withColumn("k", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("n"), "id"))).where(F.col("k") <= top)
    return results.select("query", "id", "score").unionByName(near.select("query", "id", (F.col("n") * weight).alias("score"))).groupBy("query", "id").agg(F.sum("score").alias("score"))


def chunks(docs: DataFrame, size: int = 1000, overlap: int = 200, most: int = 80, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, index, start, end, chunk): overlapping slices, trimmed, blank ones skipped without an index."""
    size = max(size, 200)
    step = size - min(overlap, size - 1)
    n = F.length(text_col)
    count = F.greatest(F.ceil((n - size) / step).cast("int") + 1, F.lit(1))
    starts = F.sequence(F.lit(0), (count - 1) * step, F.lit(step))
    rows = docs.where(n > 0).select(F.col(id_col).alias("id"), F.explode(starts).alias("at"), F.col(text_col).alias("t"))
    raw = F.substring("t", F.col("at") + 1, F.lit(size))
    rows = rows.select("id", "at", raw.alias("raw")).select("id", "at", "raw", F.regexp_replace("raw", r"^[ \t\r\n]+", "").alias("left"))
    rows = rows.select("id", (F.col("at") + F.length("raw") - F.length("left")).alias("start"), F.regexp_replace("left", r"[ \t\r\n]+$", "").alias("chunk")).where("chunk <> ''")
    index = F.row_number().over(Window.partitionBy("id").orderBy("start")) - 1
    return rows.withColumn("index", index).where(F.col("index") < most).select("id", "index", "start", (F.col("start") + F.length("chunk")).alias("end"), "chunk")


def chunk_context(hits: DataFrame, parts: DataFrame, k: int = 1, limit: int = 2_000) -> DataFrame:
    """(id, index, context): chunks within k of each hit, in order, joined by line feeds and cut."""
    near = hits.select("id", "index").join(parts.select("id", F.col("index").alias("other"), "chunk"), "id").where(F.abs(F.col("index") - F.col("other")) <= k)
    lines = F.sort_array(F.collect_list(F.struct("other", "chunk")))
    return near.groupBy("id", "index").agg(F.substring(F.trim(F.array_join(F.transform(lines, lambda x: x["chunk"]), "\n")), 1, limit).alias("context"))


def search_with_matches(items: DataFrame, queries: DataFrame, meta: DataFrame, k: int = 20, *, id_col: str = "vec_id", vec_col: str = "embedding", where: Column | None = None, most: int = 3) -> DataFrame:
    """(query, id, score, rank, tags, in_category): nearest items, and where words of the query's text stand in their metadata.

    ``queries``: (query, embedding, text); ``meta``: (id, tags, category). A word has three
    characters at least; ``tags`` are the first ``most`` that contain one. Hits without
    metadata have no tags.
    """
    words = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"\s+"), lambda w: F.length(w) > 2)
    hits = top_k(items, queries, k, id_col=id_col, vec_col=vec_col, where=where).withColumnRenamed(id_col, "id")
    rows = hits.join(queries.select("query", words.alias("_words")), "query").join(meta.select("id", "tags", "category"), "id", "left")
    has = lambda text: F.exists("_words", lambda w: F.contains(F.lower(text), w))
    tags = F.slice(F.filter(F.coalesce("tags", F.array().cast("array<string>")), has), 1, most)
    return rows.select("query", "id", "score", "rank", tags.alias("tags"), has(F.coalesce("category", F.lit(""))).alias("in_category"))


def completions(sources: list[tuple[DataFrame, float]], typed: str, most: int = 8) -> DataFrame:
    """(name, score): distinct names that contain what is typed, whatever the case, by the score of their source, then by name."""
    rows = None
    for df, score in sources:
        one = df.select(F.col("name")).where(F.contains(F.lower("name"), F.lit(typed.lower().strip()))).distinct().withColumn("score", F.lit(score))
        rows = one if rows is None else rows.unionByName(one)
    best = rows.groupBy("name").agg(F.max("score").alias("score"))
    return best.orderBy(F.desc("score"), "name").limit(most)


def highlight_segments(text: Column, query: str) -> Column:
    """The text in segments: those at even places (from 1) are words of the query, whatever their case; others may be empty."""
    words = sorted({w for w in re.split(r"\s+", query.strip()) if len(w) > 1}, key=lambda w: (-len(w), w))
    if not words:
        return F.array(text)
    marked = F.regexp_replace(text, f"(?i)({'|'.join(re.sub(r'([^A-Za-z0-9_])', r'[$1]'.replace('$1', chr(92) + '1'), w) for w in words)})", "\u0001$1\u0001")
    return F.split(marked, "\u0001")


def field_search(df: DataFrame, query: str, *, fields: dict[str, int], exact: dict[str, int] | None = None, lists: dict[str, int] | None = None, text_col: str | None = None, text_points: int = 3, last_lists: dict[str, int] | None = None, semantic: DataFrame | None = None, id_col: str = "doc_id", ts_col: str = "ts", k: int = 100, recent: int = 300) -> DataFrame:
    """(id, score, rank): points for each field that contains the query, the first k.

    ``exact`` adds points for a field that equals the query, ``lists`` for arrays with an
    element that contains it; the text counts only for a row without points so far, and
    ``last_lists`` after it. ``semantic`` (id, cosine) adds a hundred times the cosine to the
    ``recent`` newest rows, which are then results whatever their points.
    """
    q = query.lower().strip()
    has = lambda c: F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(q))
    in_list = lambda name: F.exists(F.coalesce(F.col(name), F.array().cast("array<string>")), has)
    points = F.lit(0.0)
    for name, n in fields.items():
        points = points + F.when(has(F.col(name)), n).otherwise(0)
    for name, n in (exact or {}).items():
        points = points + F.when(F.lower(F.col(name)) == q, n).otherwise(0)
    for name, n in (lists or {}).items():
        points = points + F.when(in_list(name), n).otherwise(0)
    rows = df
    if semantic is not None:
        newest = df.orderBy(F.desc(ts_col), F.desc(id_col)).limit(recent).select(F.col(id_col).alias("_id"))
        near = semantic.select(F.col("id").alias("_id"), F.col("cosine").alias("_cosine")).join(newest, "_id", "left_semi")
        rows = rows.join(near, F.col(id_col) == F.col("_id"), "left")
        points = points + F.coalesce(F.col("_cosine") * 100, F.lit(0.0))
    found = rows.withColumn("_points", points)
    score = F.col("_points")
    if text_col:
        score = score + F.when((F.col("_points") == 0) & has(F.col(text_col)), text_points).otherwise(0)
    for name, n in (last_lists or {}).items():
        score = score + F.when(in_list(name), n).otherwise(0)
    keep = (F.col("score") > 0) if semantic is None else (F.col("score") > 0) | F.col("_cosine").isNotNull()
    top = found.withColumn("score", score).where(keep).orderBy(F.desc("score"), F.desc(ts_col), id_col).limit(k)
    order = Window.orderBy(F.desc("score"), F.desc(ts_col), id_col)  # k rows at most
    return top.select(F.col(id_col).alias("id"), "score", F.row_number().over(order).alias("rank"))


def contradictions(sources: DataFrame, *, most: int = 5, by: str = "query") -> DataFrame:
    """(query, a, b, topics): the first pairs of an answer's sources that share a topic and differ in date or entities.

    ``sources``: (query, id, topics, date, entities), a bounded number of them a query, so
    pairs stay few. Dates differ only if both are set.
    """
    s = sources.select(by, "id", F.explode(F.array_distinct("topics")).alias("topic"), "date", F.array_sort(F.array_distinct("entities")).alias("entities"))
    x, y = s.alias("x"), s.alias("y")
    differ = (F.col("x.date").isNotNull() & F.col("y.date").isNotNull() & (F.col("x.date") != F.col("y.date"))) | (F.col("x.entities") != F.col("y.entities"))
    pairs = x.join(y, [by, "topic"]).where(F.col("x.id") < F.col("y.id")).where(differ)
    pairs = pairs.groupBy(by, F.col("x.id").alias("a"), F.col("y.id").alias("b")).agg(F.array_sort(F.collect_set("topic")).alias("topics"))
    return pairs.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy("a", "b"))).where(F.col("_n") <= most).drop("_n")


def spelling(words: DataFrame, dictionary: DataFrame, *, stop: tuple[str, ...] = (), least: int = 5, phonetic_from: int | None = 8) -> DataFrame:
    """(word, fixed): words (word), corrected by a dictionary (word, place).

    Stop words, known words and words under ``least`` characters stay. Else the first word by
    place, of ``least`` characters or more, that is one edit away; else, for words of
    ``phonetic_from`` characters or more, that with the same phonetic code that is nearest in
    length, the first by place; else the word itself. Words and dictionary meet on what is left
    when one letter is deleted, so one edit is an equi-join.
    """
    w = words.select(F.col("word")).where(F.col("word").isNotNull()).distinct()
    known = dictionary.select(F.lower("word").alias("known"), "place").groupBy("known").agg(F.min("place").alias("place"))
    low = F.lower("word")
    asked = w.where((F.length("word") >= least) & ~low.isin(*stop)) if stop else w.where(F.length("word") >= least)
    asked = asked.join(known, low == F.col("known"), "left_anti")
    long = known.where(F.length("known") >= least)
    cuts = lambda c: F.concat(F.array(c), F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(c.substr(F.lit(1), i - 1), c.substr(i + 1, F.length(c)))))
    a = asked.select("word", F.explode(F.array_distinct(cuts(low))).alias("key"))
    b = long.select("known", "place", F.explode(F.array_distinct(cuts(F.col("known")))).alias("key"))
    near = a.join(b, "key").where(F.levenshtein(low, F.col("known")) == 1).groupBy("word").agg(F.min_by("known", "place").alias("near"))
    out = w.join(near, "word", "left")
    sound = F.lit(None).cast("string")
    if phonetic_from is not None:
        x = asked.where(F.length("word") >= phonetic_from).select("word", phonetic_code(low).alias("code"))
        y = known.select("known", "place", phonetic_code("known").alias("code"))
        best = F.struct(F.abs(F.length("word") - F.length("known")).alias("d"), "place")
        out = out.join(x.join(y, "code").groupBy("word").agg(F.min_by("known", best).alias("sound")), "word", "left")
        sound = F.col("sound")
    return out.select("word", F.coalesce("near", sound, "word").alias("fixed"))


def sound_alikes(words: DataFrame) -> DataFrame:
    """(word, other): for words (word, code) the other word of their code that is nearest in length, the first of equals by alphabet.

    Of the words of one code and length only the first two can be anybody's, so a word meets two
    for every length of its code and never all that sound like it. The words are kept first:
    else Spark drops a distinct below this one, and codes every place of a word, twice.
    """
    rows = cut_lineage(words).select("word", "code", F.length("word").alias("n")).distinct()
    few = rows.withColumn("_k", F.row_number().over(Window.partitionBy("code", "n").orderBy("word"))).where(F.col("_k") <= 2)
    near = rows.join(few.select("code", F.col("n").alias("m"), F.col("word").alias("other")), "code").where("word <> other")
    best = F.struct(F.abs(F.col("n") - F.col("m")).alias("d"), "other")
    return near.groupBy("word").agg(F.min(best).alias("b")).select("word", F.col("b.other").alias("other"))


def by_mode(queries: DataFrame, mode: str, *, keyword: Callable[[DataFrame], DataFrame], vector: Callable[[DataFrame], DataFrame], hybrid: Callable[[DataFrame], DataFrame], least: int = 2) -> tuple[DataFrame, DataFrame]:
    """Results (query, id, score, rank, mode) of queries (query, text, embedding), and errors (query, error).

    mode is bm25, vector or hybrid. A query without a vector is searched by keywords, whatever the
    mode; one of fewer than ``least`` characters is an error. Each search is a function of queries.
    """
    if mode not in ("bm25", "vector", "hybrid"):
        raise ValueError(f"no such mode: {mode}")
    size = F.length(F.trim(F.coalesce("text", F.lit(""))))
    good = queries.where(size >= least)
    errors = queries.where(size < least).select("query", F.lit("Query is too short").alias("error"))
    told = lambda df, name: df.select("query", "id", "score", "rank", F.lit(name).alias("mode"))
    plain = told(keyword(good if mode == "bm25" else good.where("embedding IS NULL")), "bm25")
    if mode == "bm25":
        return plain, errors
    search = vector if mode == "vector" else hybrid
    return told(search(good.where("embedding IS NOT NULL")), mode).unionByName(plain), errors


def vocabulary(terms: DataFrame, subjects: DataFrame) -> DataFrame:
    """(word): terms (word: tags, categories) of five characters or more, and words of subjects (text) of 5 to 19."""
    w = terms.select(F.lower(F.trim("word")).alias("word")).where(F.length("word") >= 5)
    s = subjects.select(F.explode(F.split("text", "[^A-Za-z]+")).alias("word")).where(F.length("word").between(5, 19)).select(F.lower("word").alias("word"))
    return w.unionByName(s).distinct()


def search_issues(files: DataFrame, chunks: DataFrame, history: DataFrame, index: DataFrame | None, *, size: int, changed: object = None, indexed: object = None, lookups: int = 0, hits: int = 0) -> DataFrame:
    """(issue, n) of what is wrong with a search's tables: files and chunks (id, embedding), history (id), index (term).

    ``changed`` and ``indexed`` are the newest change and the index's time, ``lookups`` and
    ``hits`` those of its cache.
    """
    count = lambda df: df.agg(F.count("*").alias("n"))
    issue = lambda name, df: df.select(F.lit(name).alias("issue"), F.col("n").cast("long").alias("n"))
    wrong = lambda df: count(df.where(F.coalesce(F.size("embedding"), F.lit(-1)) != size)).where("n > 0")
    spark, out = files.sparkSession, []
    out.append(issue("EMPTY_FILE_COLLECTION", count(files).where("n = 0")))
    out.append(issue("EMPTY_CHUNK_COLLECTION", count(chunks).where("n = 0")))
    out.append(issue("DIMENSION_MISMATCH_FILES", wrong(files)))
    out.append(issue("DIMENSION_MISMATCH_CHUNKS", wrong(chunks)))
    out.append(issue("HISTORY_WITHOUT_EMBEDDINGS", count(history.select("id").join(files.select("id"), "id", "left_anti")).where("n > 0")))
    both = count(history).withColumnRenamed("n", "h").withColumn("n", count(files).scalar())
    out.append(issue("EMBEDDINGS_OUT_OF_SYNC", both.where(F.col("h") > 1.5 * F.col("n")).withColumn("n", F.col("h") - F.col("n"))))
    told = [("NO_BM25_INDEX", 0)] if index is None else []
    if index is not None:
        out.append(issue("EMPTY_BM25_INDEX", count(index).where("n = 0")))
        if changed is not None and indexed is not None and changed > indexed:
            told.append(("STALE_BM25_INDEX", 1))
    if lookups >= 100 and hits < 0.1 * lookups:
        told.append(("LOW_CACHE_HIT_RATE", hits))
    rows = spark.createDataFrame(told, "issue string, n long")
    for df in out:
        rows = rows.unionByName(df)
    return rows

"""Benchmark decontamination with DataFrame functions only.

The distinct word windows of the benchmark become a hash relation keyed by a 64-bit hash.
Each document's word positions are scanned once for every window length in use; a position
whose hash is in the relation is verified word by word. The relation is broadcast if its
windows' words have at most ``max_broadcast_bytes`` in all, which is counted first; beyond
that the same join is shuffled.

Hits are kept by the text's SHA-256, so copies of a text share one set of hits. Covered
words are the union of the verified windows.

Defined results: a null text or item has no words, so no hits, and is not contaminated;
an item with fewer words than a window is one window as a whole; repeated items and rows
change nothing but the number of rows. An item with a null id counts as contaminating
but has no name in ``items``. Other columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import cut_lineage, fresh_name

WINDOW = 10
#: Fixed by the word pattern [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing A-Z.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text; an empty array for null."""
    plain = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAP, " ")
    return F.filter(F.split(plain, " "), lambda w: w != "")


def benchmark_windows(benchmark: DataFrame, *, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(item, window: its words): each distinct window of each item."""
    w = benchmark.select(F.col(item_col).alias("item"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - F.lit(window - 1), F.lit(1)))
    return w.select("item", "w", F.explode(starts).alias("at")).select("item", F.slice("w", F.col("at"), window).alias("window")).distinct()


def window_hits(docs: DataFrame, windows: DataFrame, *, text_col: str = "text", max_broadcast_bytes: int = 64 << 20) -> DataFrame:
    """(sha, at, window): verified occurrences, once for each distinct text."""
    known = windows.select("window").distinct().select("window", F.size("window").alias("n"), F.xxhash64("window").alias("h"))
    size = F.sum(F.octet_length(F.array_join("window", " ")) + 16 * F.col("n") + 64)
    per_length = {r["n"]: r["size"] for r in known.groupBy("n").agg(size.alias("size")).collect()}  # a row for each length up to the window's
    if not per_length:
        return known.select(F.lit("").alias("sha"), F.lit(0).alias("at"), "window")
    if sum(per_length.values()) <= max_broadcast_bytes:
        known = F.broadcast(known)
    text = docs.select(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("sha"), words(F.col(text_col)).alias("w"))
    found = None
    for n in sorted(per_length):
        at = text.where(F.size("w") >= n).select("sha", "w", F.explode(F.sequence(F.lit(1), F.size("w") - (n - 1))).alias("at"))
        seen = at.select("sha", "at", F.slice("w", F.col("at"), n).alias("seen")).withColumn("h", F.xxhash64("seen"))
        hit = seen.join(known.where(F.col("n") == n), "h").where(F.col("seen") == F.col("window")).select("sha", "at", "window")
        found = hit if found is None else found.unionByName(hit)
    return found.distinct()


def decontamination_report(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per document: id, text_sha256, n_words, n_hit, n_items, items_sha256, contaminated."""
    windows = cut_lineage(benchmark_windows(benchmark, item_col=item_col, text_col=item_text_col, window=window))
    hits = cut_lineage(window_hits(docs, windows, text_col=text_col))
    # Words covered: each window adds what lies beyond the furthest end before it.
    by_place = Window.partitionBy("sha").orderBy("at", "end")
    ends = hits.select("sha", "at", (F.col("at") + F.size("window")).alias("end")).distinct()
    before = F.coalesce(F.max("end").over(by_place.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    covered = ends.select("sha", F.greatest(F.col("end") - F.greatest("at", before), F.lit(0)).alias("new")).groupBy("sha").agg(F.sum("new").cast("long").alias("n_hit"))
    named = hits.select("sha", "window").distinct().join(windows, "window").select("sha", F.col("item").cast("string").alias("item")).distinct()
    items = named.groupBy("sha").agg(F.sort_array(F.collect_list("item")).alias("items"))
    by_text = cut_lineage(covered.join(items, "sha", "left"))  # written, so that Spark can split the copies of a hit text
    rows = docs.select(F.col(id_col).alias(id_col), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("sha"), F.size(words(F.col(text_col))).cast("long").alias("n_words"))
    out = rows.join(by_text, "sha", "left")
    names = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        id_col, F.col("sha").alias("text_sha256"), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(names).cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` without the rows in which a benchmark window occurs; columns as they are."""
    windows = benchmark_windows(benchmark, item_col=item_col, text_col=item_text_col, window=window)
    sha = fresh_name(docs, "_sha")
    bad = window_hits(docs, windows, text_col=text_col).select(F.col("sha").alias(sha)).distinct()
    return docs.withColumn(sha, F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)).join(bad, sha, "left_anti").select(*docs.columns)


def remove_spans(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with the words inside benchmark windows taken out of ``text_col``.

    A touched text comes back as its remaining stretches between words, so everything
    outside the removed words (case, punctuation, line breaks) stays as it was.
    """
    windows = cut_lineage(benchmark_windows(benchmark, item_col=item_col, text_col=item_text_col, window=window))
    ends = window_hits(docs, windows, text_col=text_col).select("sha", "at", (F.col("at") + F.size("window")).alias("end")).distinct()
    # Spans that overlap or touch become one, so that the stretches between them are walked once.
    by_place = Window.partitionBy("sha").orderBy("at", "end")
    reached = F.max("end").over(by_place.rowsBetween(Window.unboundedPreceding, -1))
    merged = ends.withColumn("reached", reached).withColumn("island", F.sum((F.col("reached").isNull() | (F.col("at") > F.col("reached"))).cast("int")).over(by_place)).groupBy("sha", "island").agg(F.min("at").alias("at"), F.max("end").alias("end"))
    sha, spans = fresh_name(docs, "_sha"), fresh_name(docs, "_spans")
    listed = merged.groupBy(F.col("sha").alias(sha)).agg(F.sort_array(F.collect_list(F.struct("at", "end"))).alias(spans))
    rows = docs.withColumn(sha, F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)).join(listed, sha, "left")
    pieces = F.split(F.regexp_replace(F.col(text_col), r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)", "\u0000$1\u0000"), "\u0000")
    # Of the pieces, counted from 1, those at even places are the words in order. Each span gives the
    # stretch before it and the gaps between its words; what follows the last span comes after.
    part = fresh_name(docs, "_pieces")
    after = lambda i: F.when(i == 0, 1).otherwise(2 * F.get(F.col(spans), i - 1)["end"] - 1)
    before = lambda x, i: F.slice(part, after(i), 2 * x["at"] - after(i))
    gaps = lambda x: F.filter(F.slice(part, 2 * x["at"], 2 * (x["end"] - x["at"]) - 1), lambda _, k: k % 2 == 1)
    kept = F.array_join(F.transform(spans, lambda x, i: F.array_join(F.concat(before(x, i), gaps(x)), "")), "")
    tail = F.array_join(F.slice(part, after(F.size(spans)), F.greatest(F.size(part) - after(F.size(spans)) + 1, F.lit(0))), "")
    touched = rows.withColumn(part, pieces)
    return touched.withColumn(text_col, F.when(F.col(spans).isNull(), F.col(text_col)).otherwise(F.concat(kept, tail))).select(*docs.columns)

"""Exact dedup by content-defined chunk recipes.

Every text is cut where a rolling hash of its last 32 bytes says so, so that equal
stretches give equal chunks. A chunk's identifier is its SHA-256 and length. Identifiers are
counted first, and those seen more than once are verified against the chunks' bytes: only
texts that hold such a chunk are cut again, which a Bloom filter of bounded size tells in the
tasks, and each of their chunks crosses the network once a map task at most. Two texts are
equal when their ordered lists of identifiers are, so a long text is never moved or compared
as a whole.

Defined results: a null text counts as empty and equals an empty one; an empty text has an
empty recipe. The largest id of a group stays; a null id only if the group has no other.
Of rows repeated with the id that stays one is kept. Other columns are carried along.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.scan import bounded_batches
from corpusloom.session import cut_lineage, fresh_name

WINDOW = 32  # bytes the rolling hash sees; a power of two
MIN_CHUNK, MASK, MAX_CHUNK = 1_024, (1 << 12) - 1, 16_384
_TABLE = np.random.default_rng(20_24).integers(0, 1 << 32, 256, dtype=np.uint32)


def cut_points(data: bytes) -> list[int]:
    """Ends of the chunks: where 12 bits of the rolling hash are zero, within the size limits."""
    n = len(data)
    if n <= MIN_CHUNK:
        return [n] if n else []
    h = _TABLE[np.frombuffer(data, dtype=np.uint8)]
    width = 1
    while width < WINDOW:  # the hash of 2w bytes is that of w bytes, turned, with that of the next w
        older = h[:-width]
        h = h.copy()
        h[width:] ^= (older << np.uint32(width)) | (older >> np.uint32(32 - width))
        width *= 2
    ends, start = [], 0
    for at in (np.flatnonzero((h & MASK) == 0) + 1).tolist():
        while at - start > MAX_CHUNK:
            start += MAX_CHUNK
            ends.append(start)
        if at - start >= MIN_CHUNK:
            ends.append(at)
            start = at
    while n - start > MAX_CHUNK:
        start += MAX_CHUNK
        ends.append(start)
    return ends if start == n else [*ends, n]


def chunks_of(text: str | None) -> list[bytes]:
    data = (text or "").encode()
    ends = cut_points(data)
    return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def identifier(chunk: bytes) -> bytes:
    return hashlib.sha256(chunk).digest()[:24] + len(chunk).to_bytes(8, "little")


def recipe_column(text: Column, identify: Callable[[bytes], bytes] = identifier) -> Column:
    """struct(sha: lower-case hex of the text, size: its bytes, recipe: ordered chunk identifiers)."""

    @F.pandas_udf("sha string, size long, recipe binary")
    def recipes(texts: pd.Series) -> pd.DataFrame:
        cut = [chunks_of(x) for x in texts]
        return pd.DataFrame({"sha": [hashlib.sha256(b"".join(x)).hexdigest() for x in cut], "size": [sum(map(len, x)) for x in cut], "recipe": [b"".join(map(identify, x)) for x in cut]})

    return recipes(text)


def texts_with_repeated_chunks(cut: DataFrame) -> DataFrame:
    """(text_sha256) of texts with a chunk identifier that occurs more than once in all recipes (text_sha256, recipe)."""
    texts = cut.where(F.length("recipe") > 0).groupBy("text_sha256", "recipe").agg(F.count("*").alias("n"))
    places = F.sequence(F.lit(0), (F.length("recipe") / 32).cast("int") - 1)
    ids = texts.select("text_sha256", "n", F.explode(F.transform(places, lambda k: F.substr(F.col("recipe"), 1 + 32 * k, F.lit(32)))).alias("id"))
    repeated = ids.groupBy("id").agg(F.sum("n").alias("n")).where("n > 1").select("id")
    return ids.join(repeated, "id", "left_semi").select("text_sha256").distinct()


FILTER_BITS = 1 << 27  # of the largest Bloom filter; a fuller one lets more texts through, and none is missed


def bloom(shas: DataFrame, most: int = FILTER_BITS) -> np.ndarray:
    """The words of a Bloom filter over SHA-256 digests in hexadecimal: three of their own 32-bit parts say where."""
    shas = cut_lineage(shas)
    bits = 1 << max(6, min((12 * shas.count()).bit_length(), most.bit_length() - 1))
    at = F.explode(F.array(*(F.conv(F.substring("text_sha256", 1 + 8 * k, 8), 16, 10).cast("long") % bits for k in range(3))))
    places = shas.select(at.alias("at"))
    words = places.groupBy(F.expr("at div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits")).toPandas()  # bits / 64 rows at most
    out = np.zeros(bits // 64, dtype=np.int64)
    out[words["word"].to_numpy(dtype=np.int64)] = words["bits"].to_numpy(dtype=np.int64)
    return out.view(np.uint64)


def may_hold(filter_: np.ndarray, digest: bytes) -> bool:
    at = (int.from_bytes(digest[4 * k : 4 * k + 4], "big") % (64 * len(filter_)) for k in range(3))
    return all(int(filter_[a >> 6]) >> (a & 63) & 1 for a in at)


def collided_identifiers(docs: DataFrame, filter_: np.ndarray, text_col: str = "text", identify: Callable[[bytes], bytes] = identifier) -> DataFrame:
    """(id, low, high) of chunks that share an identifier with different bytes: expected to be empty.

    Only texts that the filter may hold send their chunks. Chunks of a task that are seen
    again are not sent again, and equal ones of several tasks meet in a partial aggregation.
    """
    sent = docs.sparkSession.sparkContext.broadcast(filter_)

    def distinct_chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[bytes] = set()
        for batch in batches:
            new = []
            for text in batch["text"]:
                if not text or not may_hold(sent.value, hashlib.sha256(text.encode()).digest()):
                    continue
                for chunk in chunks_of(text):
                    key = hashlib.blake2b(chunk, digest_size=16).digest()
                    if key not in seen:
                        seen.add(key)
                        new.append((identify(chunk), chunk))
            if len(seen) > 1_000_000:
                seen.clear()
            if new:
                yield pd.DataFrame(new, columns=["id", "content"])

    parts = docs.select(F.col(text_col).alias("text")).mapInPandas(distinct_chunks, "id binary, content binary")
    # Rows of one identifier meet in one task each; its contents are grouped as bytes, so equal hashes are verified.
    contents = parts.groupBy("id").agg(F.min("content").alias("low"), F.max("content").alias("high"))
    return contents.where(F.col("low") != F.col("high")).select("id", "low", "high")


def recipes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", identify: Callable[[bytes], bytes] = identifier) -> DataFrame:
    """(_id, text_sha256, size, recipe) of every row, written, with verified identifiers.

    Should an identifier ever stand for different bytes, texts that hold it get their bytes
    as their recipe, which compares them exactly as well.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    cut = rows.withColumn("_r", recipe_column(F.col("_text"), identify))
    plain = cut_lineage(cut.select("_id", F.col("_r.sha").alias("text_sha256"), F.col("_r.size").alias("size"), F.col("_r.recipe").alias("recipe")))
    filter_ = bloom(texts_with_repeated_chunks(plain))
    bad = [bytes(r["id"]) for r in collided_identifiers(rows, filter_, "_text", identify).limit(1_000).collect()]
    if len(bad) == 1_000:
        raise RuntimeError("SHA-256 identifiers collide in bulk: the hash function is broken")
    if not bad:
        return plain
    recipe = F.col("_r.recipe")
    for one in bad:
        recipe = F.when(F.instr(F.hex(F.col("_r.recipe")), one.hex().upper()) > 0, F.encode(F.coalesce("_text", F.lit("")), "UTF-8")).otherwise(recipe)
    return cut_lineage(cut.select("_id", F.col("_r.sha").alias("text_sha256"), F.col("_r.size").alias("size"), recipe.alias("recipe")))


def exact_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", identify: Callable[[bytes], bytes] = identifier) -> DataFrame:
    """One row per document: its id, keep_id, group_size, kept, text_sha256.

    Groups are summed before the shuffle and written; documents then meet their group in a
    plain join on the recipe, where Spark can split a group of any size over tasks. Only
    rows that may stay (one a group, or repeated ones) are counted once more.
    """
    rows = recipes(docs, id_col=id_col, text_col=text_col, identify=identify)
    groups = cut_lineage(rows.groupBy("recipe").agg(F.max("_id").alias("keep_id"), F.count("*").alias("group_size")))
    joined = cut_lineage(rows.join(groups, "recipe").select("_id", "keep_id", "group_size", "text_sha256"))
    may_stay = F.col("_id").eqNullSafe(F.col("keep_id"))
    gone = joined.where(~may_stay).select("_id", "keep_id", "group_size", F.lit(False).alias("kept"), "text_sha256")
    # Repeated rows are equal in all columns here: count them, keep the first of each.
    same = joined.where(may_stay).groupBy("_id", "keep_id", "group_size", "text_sha256").agg(F.count("*").alias("_n"))
    nth = F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))).alias("_nth")
    stay = same.select("_id", "keep_id", "group_size", nth, "text_sha256").select("_id", "keep_id", "group_size", (F.col("_nth") == 1).alias("kept"), "text_sha256")
    return gone.unionByName(stay).withColumnRenamed("_id", id_col)


def drop_exact_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that another row with an equal text replaces; columns as they are.

    The rows are shuffled once, to their decisions; of rows repeated with the id that
    stays one is kept, in the same partitioning.
    """
    sha, key, nth = fresh_name(docs, "_sha"), fresh_name(docs, "_key"), fresh_name(docs, "_nth")
    whole_id = F.coalesce(F.concat(F.lit("="), F.col(id_col).cast("string")), F.lit(""))
    stays = exact_groups(docs, id_col=id_col, text_col=text_col).where("kept").select(whole_id.alias(key), F.col("text_sha256").alias(sha))
    rows = docs.withColumns({key: whole_id, sha: F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)})
    left = rows.join(stays, [key, sha], "left_semi").withColumn(nth, F.row_number().over(Window.partitionBy(key, sha).orderBy(key)))
    return left.where(F.col(nth) == 1).select(*docs.columns)

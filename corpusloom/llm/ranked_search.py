"""Ranked lexical search: a blocked sparse matrix product in exact 64-bit integers.

The matrix of items and terms (how often an item has a term) is multiplied by the matrix of
terms and documents (what a term adds to a document's score). Documents pass in blocks. A
block's rows, one a term, are merged row by row as Gustavson's algorithm does: an item's row
of the product is the sum of the rows of its terms, each times its multiplicity. A block
keeps the best documents of each item, blocks are reduced in their task, and what tasks send
on is reduced in two steps, so that no item meets all tasks in one.

Terms of no item are dropped while a document is read, but count for its length. Items are a
query set: they are counted first, and a set of more than ``max_pairs`` items' terms is cut
into blocks of items, each of which passes over the documents once.

Defined results: a null or empty text has no terms; such a document counts nowhere and is
never found, such an item finds nothing. Rows of one item id are one item: identical rows
count once, terms of different texts add up. Repeated documents are documents of their own,
found by themselves. Null ids are ids like any other, the last among equal scores. Other
columns are not looked at. Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.scan import WORD_BYTES, bounded_batches
from corpusloom.session import cut_lineage

BLOCK = 4_096  # documents of one product
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TERMS = r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"  # after lower-casing A-Z


@dataclass(frozen=True)
class Items:
    """The rows of the first matrix: of item i, terms[ends[i]:ends[i + 1]] and their multiplicity."""

    ids: pa.Array
    ends: np.ndarray
    terms: np.ndarray
    times: np.ndarray


def item_terms(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item, term, times): the terms of each item with their multiplicity."""
    rows = items.select(F.col(item_col).alias("item"), F.col(text_col).alias("text")).distinct()
    words = F.regexp_extract_all(F.translate("text", _UPPER, _LOWER), F.lit(_TERMS), 1)
    return rows.select("item", F.explode(words).alias("term")).groupBy("item", "term").agg(F.count("*").alias("times"))


def count_terms(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """(id, n, terms, tf) of each document with a term: its number of terms, and the vocabulary's terms in it with their counts."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = sent.value.get
        for batch in batches:
            sizes, ends, terms, tf = [], [0], [], []
            for text in batch.column("text").to_pylist():
                words = (text or "").encode().translate(WORD_BYTES).split()
                found = Counter(map(get, words))
                found.pop(None, None)
                sizes.append(len(words))
                terms.extend(found)
                tf.extend(found.values())
                ends.append(len(terms))
            ends = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (terms, tf)]
            out = pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, pa.int64()), *lists], ["id", "n", "terms", "tf"])
            yield out.filter(pc.greater(out.column("n"), 0))

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(count, f"id {rows.schema['id'].dataType.simpleString()}, n long, terms array<int>, tf array<int>")


def collection_counts(counted: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """Documents, all their terms, and the documents of each vocabulary term; tasks send on sums."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs = total = 0
        df = np.zeros(n_terms, dtype=np.int64)
        for batch in batches:
            docs += len(batch)
            total += pc.sum(batch.column("n")).as_py() or 0
            df += np.bincount(batch.column("terms").flatten().to_numpy(), minlength=n_terms)
        seen = np.flatnonzero(df)
        term = np.concatenate([[-1, -2], seen]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(np.concatenate([[docs, total], df[seen]]).astype(np.int64))], ["term", "n"])

    sums = {r["term"]: r["n"] for r in counted.mapInArrow(add_up, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}  # a row a term
    df = np.array([sums.get(t, 0) for t in range(n_terms)], dtype=np.int64)
    return sums.get(-1, 0), sums.get(-2, 0), df


def term_weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    """floor(1000 ln((2N + 2) / (2 df + 1))) as integers."""
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], dtype=np.int64)


def block_product(items: Items, weights: np.ndarray, n_docs: int, total: int, sizes: np.ndarray, lengths: np.ndarray, terms: np.ndarray, tf: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(item, its scores of the block's documents): rows of the product, merged one after another.

    ``sizes`` are the documents' numbers of terms; document d has the next ``lengths[d]`` of ``terms`` and ``tf``.
    """
    tf, doc = tf.astype(np.int64), np.repeat(np.arange(len(sizes)), lengths)
    m = 100 - 75 + (75 * sizes * n_docs) // total
    impact = weights[terms] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
    order = np.argsort(terms, kind="stable")
    doc, impact = doc[order], impact[order]
    ends = np.concatenate([[0], np.cumsum(np.bincount(terms, minlength=len(weights)))])
    for i in range(len(items.ids)):
        row = np.zeros(len(sizes), dtype=np.int64)
        for at in range(items.ends[i], items.ends[i + 1]):
            a, b = ends[items.terms[at]], ends[items.terms[at] + 1]
            row[doc[a:b]] += items.times[at] * impact[a:b]  # a term has a document once
        yield i, row


def first_of_each(found: pa.Table, k: int) -> pa.Table:
    """Of (item number, id, score) the k first of each item: highest scores, then smallest ids."""
    found = found.take(pc.sort_indices(found, sort_keys=[("item", "ascending"), ("score", "descending"), ("id", "ascending")]))
    item = found.column("item").to_numpy()
    return found.filter(pa.array(np.arange(len(item)) - np.searchsorted(item, item) < k))


def best_of_blocks(counted: DataFrame, items: Items, weights: np.ndarray, n_docs: int, total: int, k: int, item_type: str) -> DataFrame:
    """(item, id, score): each task's k best documents of each item."""
    sent = counted.sparkSession.sparkContext.broadcast((items, weights))
    id_type = counted.schema["id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights = sent.value
        kept = None
        for batch in batches:
            for a in range(0, len(batch), BLOCK):
                block = batch.slice(a, BLOCK)
                block = block.take(pc.sort_indices(block.column("id")))  # ids in order: of equal scores the first places are the smallest ids
                terms, ids = block.column("terms"), block.column("id")
                parts = [] if kept is None else [kept]
                for i, row in block_product(items, weights, n_docs, total, block.column("n").to_numpy(), pc.list_value_length(terms).to_numpy(), terms.flatten().to_numpy(), block.column("tf").flatten().to_numpy()):
                    place = np.flatnonzero(row)
                    if len(place) > k:
                        edge = np.partition(row[place], len(place) - k)[len(place) - k]
                        place = place[row[place] >= edge]
                        place = place[np.argsort(-row[place], kind="stable")[:k]]
                    if len(place):
                        parts.append(pa.table({"item": pa.array(np.full(len(place), i, dtype=np.int64)), "id": ids.take(pa.array(place)), "score": pa.array(row[place])}))
                if parts:
                    kept = first_of_each(pa.concat_tables(parts), k)
        if kept is not None:
            yield from pa.table({"item": items.ids.take(kept.column("item").combine_chunks()), "id": kept.column("id"), "score": kept.column("score")}).combine_chunks().to_batches()

    return counted.mapInArrow(score, f"item {item_type}, id {id_type}, score long")


def ranked_search(docs: DataFrame, items: DataFrame, *, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", max_pairs: int = 1_000_000) -> DataFrame:
    """(item_col, rank, id_col, score): the k best documents of each item, as the module says."""
    spark = docs.sparkSession
    bounded_batches(spark)
    pairs = cut_lineage(item_terms(items, item_col, item_text_col))
    item_type = pairs.schema["item"].dataType.simpleString()
    blocks, out = max(1, -(-pairs.count() // max_pairs)), None
    for n in range(blocks):
        known = pairs.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == n).orderBy("item", "term").toArrow()  # max_pairs rows, about
        terms = sorted({t.encode() for t in known.column("term").to_pylist()})
        number = {t: i for i, t in enumerate(terms)}
        ids = known.column("item").combine_chunks()
        new = np.array([True, *(a != b for a, b in zip(ids.to_pylist(), ids.to_pylist()[1:], strict=False))][: len(ids)], dtype=bool)
        starts = np.flatnonzero(new)
        asked = Items(ids.take(pa.array(starts)), np.append(starts, len(ids)), np.array([number[t.encode()] for t in known.column("term").to_pylist()], dtype=np.int64), known.column("times").to_numpy())
        counted = cut_lineage(count_terms(docs, number, id_col, text_col))
        n_docs, total, df = collection_counts(counted, len(terms))
        found = best_of_blocks(counted.where(F.size("terms") > 0), asked, term_weights(n_docs, df), n_docs, total, k, item_type)
        steps = max(1, math.isqrt(counted.rdd.getNumPartitions()))
        order = [F.desc("score"), F.asc_nulls_last("id")]
        some = found.withColumn("part", F.spark_partition_id() % steps).withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).where(F.col("rank") <= k)
        best = some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
        best = best.select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")
        out = best if out is None else out.unionByName(best)
    return out

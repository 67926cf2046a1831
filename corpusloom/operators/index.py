"""A stored inverted index: built once, changed by deltas, searched without the texts.

The index is a ``SnapshotStore`` of segments. Building writes one; a delta of new, changed
and deleted documents writes another that says which older rows it ends. Tables:

``forward``   a document's field, its size, its terms with their counts
``postings``  a term's documents in blocks: those of one field, term and range of documents,
              with the block's largest count and smallest size; in folders by ``bucket`` of the
              term's hash, sorted by term, so that a search reads the folders of its terms
``terms``     how many documents more (or fewer) have a term in a field, sorted by bucket
``totals``    how many documents, sized documents and tokens more (or fewer) a field has
``dead``      keys that the segment ends in the segments before it

A block can add to a score no more than its largest count at its smallest size does, whatever
the collection's statistics are. A search adds these bounds up for each query and range of
documents, scores the best ranges, and then only those whose bound reaches the k-th score
found: the rows are those of scoring everything.

What travels are documents' term lists (once, to the tasks of their ranges), blocks (once, to
the tasks of their buckets) and, in a search, the blocks of the queries' terms, to the tasks of
their ranges. A task adds up a range's scores and sends on the k best of each query; no row of
a posting, or of a query and a document, is shuffled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.operators.history import latest_per_key
from corpusloom.operators.search import K1, B, _tokens, tokens
from corpusloom.operators.vectors import Running
from corpusloom.session import cut_lineage, small_batches
from corpusloom.sources.snapshots import Segment, SnapshotStore, Version

RANGE = 512  # documents of a block, about
MAX_BUCKETS = 4_096
BUCKET_DOCS = 20_000  # documents for each bucket of terms
SPREAD = 2_048  # ranges of a bucket that one task writes
PACKED = 4_096  # forward rows, about, whose blocks are made together
MAX_KNOWN = 500_000  # terms of queries, by field, that are sent to every task; a search for more is done in parts
TILE = 1_024  # queries whose scores in a range are added up together


@dataclass(frozen=True)
class IndexStatus:
    """What a user sees of an index: is there one, its documents, its version, whether the collection has changed since."""

    built: bool
    documents: int
    version: int
    segments: int
    indexed_to: int | None
    stale: bool


def _forward(docs: DataFrame, fields: list[str], key: str, cut: dict[str, int]) -> DataFrame:
    """(key, field, size, terms, tf): one row for a document and field; a null field has no size."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for n, name in enumerate(fields):
                words = [_tokens(text) for text in batch[f"f{n}"]]
                found = [Counter(w) for w in words]
                sizes = [None if text is None else len(w) for text, w in zip(batch[f"f{n}"], words, strict=True)]
                yield pd.DataFrame({"key": batch["key"], "field": name, "size": pd.array(sizes, dtype="Int64"), "terms": [[t.decode() for t in c] for c in found], "tf": [list(c.values()) for c in found]})

    small_batches(docs.sparkSession)
    text = lambda f: F.substring(F.col(f).cast("string"), 1, cut[f]) if f in cut else F.col(f).cast("string")
    rows = docs.select(F.col(key).alias("key"), *(text(f).alias(f"f{n}") for n, f in enumerate(fields)))
    return rows.mapInPandas(count, f"key {rows.schema['key'].dataType.simpleString()}, field string, size long, terms array<string>, tf array<int>")


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _entries(forward: DataFrame) -> DataFrame:
    one = forward.select("key", "field", "size", F.explode(F.arrays_zip("terms", "tf")).alias("e"))
    return one.select("key", "field", "size", F.col("e.terms").alias("term"), F.col("e.tf").alias("tf"))


def _range(key: Column, ranges: int) -> Column:
    """A hash of the key, so that blocks of all terms have the same ranges."""
    return F.pmod(F.xxhash64(key), F.lit(ranges)).cast("int")


def _pack(t: pa.Table) -> pa.Table:
    """Blocks of forward rows: their postings sorted by range, field and term, and cut where these change."""
    key, field, size, terms, tf, at = (t.column(c).combine_chunks() for c in ("key", "field", "size", "terms", "tf", "range"))
    terms = pc.split_pattern(terms, " ")
    owner = pc.list_parent_indices(terms).to_numpy()
    word, name = terms.flatten().dictionary_encode(), field.dictionary_encode()
    code = word.indices.to_numpy()
    at = at.to_numpy()
    order = np.argsort(((at.astype(np.int64) - at[0]) * len(name.dictionary) + name.indices.to_numpy())[owner] * len(word.dictionary) + code, kind="stable")
    owner, code = owner[order], code[order]
    named = name.indices.to_numpy()[owner]
    first = np.flatnonzero(np.append(True, (at[owner[1:]] != at[owner[:-1]]) | (named[1:] != named[:-1]) | (code[1:] != code[:-1])))
    tf, size = tf.flatten().to_numpy()[order], size.fill_null(0).to_numpy()[owner].astype(np.int32)
    ends = pa.array(np.append(first, len(order)), pa.int32())
    listed = lambda x: pa.ListArray.from_arrays(ends, x)
    return pa.table({
        "field": name.dictionary.take(pa.array(named[first])), "term": word.dictionary.take(pa.array(code[first])), "range": at[owner[first]],
        "keys": listed(key.take(pa.array(owner))), "tfs": listed(pa.array(tf, pa.int32())), "sizes": listed(pa.array(size, pa.int32())),
    })


def _blocks(forward: DataFrame, note: dict, ranges: int) -> DataFrame:
    """Postings in blocks, each of one range, field and term: documents go to the tasks of their ranges, and whole blocks to those of their buckets."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= PACKED:
                t = pa.Table.from_batches(held)
                at = t.column("range").to_numpy()
                whole = int(np.searchsorted(at, at[-1]))  # the last range may go on
                if whole:
                    yield from _pack(t.slice(0, whole)).to_batches(max_chunksize=20_000)
                held = t.slice(whole).combine_chunks().to_batches()
        if held and sum(b.num_rows for b in held):
            yield from _pack(pa.Table.from_batches(held)).to_batches(max_chunksize=20_000)

    key = forward.schema["key"].dataType.simpleString()
    # Terms have no blanks and travel as one string.
    rows = forward.where(F.size("terms") > 0).select("key", "field", "size", F.concat_ws(" ", "terms").alias("terms"), "tf", _range(F.col("key"), ranges).alias("range")).repartition("range").sortWithinPartitions("range")
    rows = rows.mapInArrow(pack, f"field string, term string, range int, keys array<{key}>, tfs array<int>, sizes array<int>")
    # Tasks get whole blocks of a bucket, and of a bucket with very many ranges a part of these.
    bucket = _bucket(F.col("term"), note["buckets"])
    rows = rows.repartition(bucket, F.floor(F.col("range") / SPREAD)).withColumns({"max_tf": F.array_max("tfs"), "min_size": F.array_min("sizes").cast("long"), "n": F.size("keys"), "bucket": bucket})
    return rows.sortWithinPartitions("bucket", "term", "range")


def _totals(forward: DataFrame, sign: int) -> DataFrame:
    return forward.groupBy("field").agg((sign * F.count("*")).alias("docs"), (sign * F.count("size")).alias("sized"), (sign * F.coalesce(F.sum("size"), F.lit(0))).alias("tokens"))


def _by_bucket(terms: DataFrame) -> DataFrame:
    return terms.select("field", "term", "df", "bucket").repartition("bucket").sortWithinPartitions("bucket", "term")


def _ended_terms(forward: DataFrame, buckets: int) -> DataFrame:
    """What ended rows had counted for."""
    return _by_bucket(_entries(forward).groupBy("field", "term").agg((-F.count("*")).alias("df")).withColumn("bucket", _bucket(F.col("term"), buckets)))


class StoredIndex:
    """The index of a collection in a folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.store = spark, SnapshotStore(spark, folder)

    def build(self, docs: DataFrame, fields: dict[str, float], *, key: str = "doc_id", ts: str | None = None, cut: dict[str, int] | None = None, buckets: int | None = None) -> Version:
        """Indexes the newest row (by ``ts``) of each key; rows without a key are no documents.

        ``fields`` have their weights; ``cut`` shortens fields to so many characters first.
        ``buckets`` follow the number of documents unless they are given.
        What the index held before is replaced in one commit.
        """
        newest = docs.where(F.col(key).isNotNull())
        newest = newest if ts is None else latest_per_key(newest, key, F.desc_nulls_last(ts))
        buckets = buckets or min(MAX_BUCKETS, max(8, -(-docs.count() // BUCKET_DOCS)))
        to = None if ts is None else docs.agg(F.max(ts)).first()[0]
        note = {"fields": fields, "key": key, "ts": ts, "cut": cut or {}, "buckets": buckets, "to": to}
        return self._segment(newest, None, note, None)

    def apply(self, changed: DataFrame | None, deleted: DataFrame | None = None) -> Version:
        """One more segment: ``changed`` rows (new, or in place of their key's), and keys that are ``deleted``."""
        now = self.store.latest()
        if now is None:
            raise ValueError("there is no index: build it first")
        key, ts = now.note["key"], now.note["ts"]
        new = changed.where(F.col(key).isNotNull()) if changed is not None else None
        keys = None
        for df in (new, deleted):
            one = None if df is None else df.select(F.col(key).alias("key"))
            keys = one if keys is None else keys if one is None else keys.unionByName(one)
        keys = keys.where("key IS NOT NULL").distinct()
        if new is not None and ts is not None:
            new = latest_per_key(new, key, F.desc_nulls_last(ts))
        to = now.note["to"]
        if ts is not None and changed is not None:
            to = max((x for x in (to, changed.agg(F.max(ts)).first()[0]) if x is not None), default=None)
        return self._segment(new, keys, now.note | {"to": to}, now)

    def _segment(self, docs: DataFrame | None, ended: DataFrame | None, note: dict, now: Version | None) -> Version:
        put, buckets, fields = self.store.write, note["buckets"], list(note["fields"])
        parts: dict[str, list] = {"forward": [], "postings": [], "terms": [], "totals": [], "dead": []}
        if docs is not None:
            forward = put(_forward(docs, fields, note["key"], note["cut"]))
            rows = self.store.segment(forward)
            postings, ranges = self._put_blocks(rows, note)
            parts["forward"].append(forward)
            parts["postings"].append(postings)
            parts["terms"].append(self._put_terms(postings))
            parts["totals"].append(put(_totals(rows, 1)))
            note = note | {"ranges": [*note.get("ranges", []), ranges]}
        if ended is not None:
            # What the ended rows had counted for is taken off: their forward rows say it.
            ended = cut_lineage(ended)
            old = self._live(self.store.read("forward", now), now).join(ended, "key", "left_semi")
            parts["terms"].append(put(_ended_terms(old, buckets)))
            parts["totals"].append(put(_totals(old, -1)))
            parts["dead"].append(put(ended.withColumn("before", F.lit(len(now.tables["forward"])))))
        if now is None:
            base = self.store.latest()
            return self.store.commit({t: tuple(x) for t, x in parts.items()}, note=note, base=base)
        return self.store.commit({t: (*now.tables.get(t, ()), *x) for t, x in parts.items()}, note=note, base=now)

    def _put_blocks(self, forward: DataFrame, note: dict) -> tuple[Segment, int]:
        """The postings of a segment, and how many ranges they have."""
        ranges = max(1, -(-forward.count() // (RANGE * len(note["fields"]))))
        return self.store.write(_blocks(forward, note, ranges), ("bucket",)), ranges

    def _put_terms(self, postings: Segment) -> Segment:
        """Documents of each term, from the blocks as they are stored: sorted by term, so that tasks send little more than a row a term."""
        return self.store.write(_by_bucket(self.store.segment(postings).groupBy("bucket", "field", "term").agg(F.sum("n").alias("df"))))

    def _live(self, rows: DataFrame, version: Version) -> DataFrame:
        """Without rows (key, segment) that a later segment ends."""
        dead = self.store.read("dead", version)
        if dead is None:
            return rows
        last = dead.groupBy("key").agg(F.max("before").alias("_before"))
        return rows.join(last, "key", "left").where(F.col("_before").isNull() | (F.col("segment") >= F.col("_before"))).drop("_before")

    def status(self, docs: DataFrame | None = None) -> IndexStatus:
        """``docs``: the collection, to tell whether it is newer than the index."""
        now = self.store.latest()
        if now is None:
            return IndexStatus(False, 0, 0, 0, None, True)
        n = self.store.read("totals", now).groupBy("field").agg(F.sum("docs").alias("n")).agg(F.max("n")).first()[0]
        newest = docs.agg(F.max(now.note["ts"])).first()[0] if docs is not None and now.note["ts"] else None
        return IndexStatus(True, n or 0, now.number, len(now.tables["forward"]), now.note["to"], newest is not None and (now.note["to"] is None or newest > now.note["to"]))

    def clear(self) -> None:
        """Leaves an empty store: a search needs another build."""
        self.store._fs.delete(self.store._path(""), True)

    def term_counts(self, queries: DataFrame | None = None) -> DataFrame:
        """(field, term, df) of live documents; with ``queries`` (term) of their terms only, from their buckets."""
        rows = self.store.read("terms")
        if queries is not None:
            rows = rows.where(F.col("bucket").isin(self._buckets(queries))).join(queries.select("term").distinct(), "term", "left_semi")
        return rows.groupBy("field", "term").agg(F.sum("df").alias("df")).where("df > 0")

    def _buckets(self, terms: DataFrame) -> list[int]:
        """At most as many numbers as the index has buckets."""
        n = self.store.latest().note["buckets"]
        return [r["b"] for r in terms.select(_bucket(F.col("term"), n).alias("b")).distinct().collect()]

    def search(self, queries: DataFrame, k: int = 20, *, probes: int = 2, report: dict | None = None) -> DataFrame:
        """(query, id, score, rank): the k best documents of each query (query, text) by BM25 over the weighted fields.

        ``probes`` ranges a query are scored to learn the k-th score, the rest by their bounds.
        ``report`` gets the blocks of the queries' terms and how many of them were scored.
        """
        version = self.store.latest()
        if version is None:
            raise ValueError("there is no index: build it first")
        asked = cut_lineage(queries.select("query", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")).distinct())
        buckets = self._buckets(asked)
        postings = self.store.read("postings", version)
        weights = self.spark.createDataFrame([(f, float(w)) for f, w in version.note["fields"].items()], "field string, boost double")
        totals = self.store.read("totals", version).groupBy("field").agg(F.sum("docs").alias("docs"), (F.sum("tokens") / F.nullif(F.sum("sized"), F.lit(0))).alias("mean"))
        known = self.term_counts(asked).join(F.broadcast(totals), "field").join(F.broadcast(weights), "field")  # a row a field
        idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        known = cut_lineage(asked.join(known, "term").select("query", "field", "term", (F.col("boost") * idf).alias("w"), F.greatest("mean", F.lit(1e-9)).alias("mean")))
        if known.count() > MAX_KNOWN:
            sizes = known.groupBy("query").agg(F.count("*").alias("n")).orderBy("query").collect()
            spans, total = [], 0  # of queries in order, with so many terms at most, or one query
            for r in sizes:
                if not spans or total + r["n"] > MAX_KNOWN:
                    spans.append([r["query"], r["query"]])
                    total = 0
                spans[-1][1], total = r["query"], total + r["n"]
            out = None
            for span in spans if len(spans) > 1 else ():
                told = None if report is None else {}
                one = self.search(queries.where(F.col("query").between(*span)), k, probes=probes, report=told)
                out = one if out is None else out.unionByName(one)
                for name, n in (told or {}).items():
                    report[name] = report.get(name, 0) + n
            if out is not None:
                return out
        live = postings.where(F.col("bucket").isin(buckets)).join(F.broadcast(known.select("field", "term").distinct()), ["field", "term"], "left_semi")
        bound = F.col("w") * (F.col("max_tf") * (K1 + 1) / (F.col("max_tf") + K1 * (1 - B + B * F.col("min_size") / F.col("mean"))))
        heads = live.select("field", "term", "segment", "range", "max_tf", "min_size").join(F.broadcast(known), ["field", "term"])
        bounds = heads.groupBy("query", "segment", "range").agg(F.sum(bound).alias("bound"), F.count("*").alias("blocks"))
        bounds = cut_lineage(bounds.withColumn("nth", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("bound"), "segment", "range"))))
        score = self._scorer(live, known, version, k)
        best = Window.partitionBy("query").orderBy(F.desc("score"), "key")
        probed = bounds.where(F.col("nth") <= probes)
        first = cut_lineage(score(probed, True).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k))
        edge = first.where(F.col("rank") == k).select("query", F.col("score").alias("edge"))
        rest = bounds.where(F.col("nth") > probes).join(edge, "query", "left").where(F.col("edge").isNull() | (F.col("bound") >= F.col("edge") - 1e-8))
        if report is not None:
            every, read = (df.agg(F.coalesce(F.sum("blocks"), F.lit(0))).first()[0] for df in (bounds, rest))
            report |= {"blocks": every, "scored": read + probed.agg(F.coalesce(F.sum("blocks"), F.lit(0))).first()[0]}
        found = first.select("query", "key", "score").unionByName(score(rest, False))
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query", F.col("key").alias("id"), "score", "rank")

    def _scorer(self, live: DataFrame, known: DataFrame, version: Version, k: int) -> Callable[[DataFrame, bool], DataFrame]:
        """A function that scores some (query, segment, range): the k best (query, key, score) of a task; ``few``: there are so few that their blocks alone are sent.

        The tasks of a range get its blocks, its keys that later segments end, and the queries that ask for it.
        """
        listed: dict[tuple[str, str], list[tuple[object, float]]] = {}
        mean: dict[str, float] = {}
        for r in known.orderBy("field", "term", "query").collect():  # MAX_KNOWN rows at most, or those of one query
            listed.setdefault((r["field"], r["term"]), []).append((r["query"], r["w"]))
            mean[r["field"]] = r["mean"]
        names = sorted({q for x in listed.values() for q, _ in x})
        number = {q: n for n, q in enumerate(names)}
        weights = {x: (np.array([number[q] for q, _ in rows]), np.array([w for _, w in rows])) for x, rows in listed.items()}
        sent = self.spark.sparkContext.broadcast((number, weights, mean))
        key, query = live.schema["keys"].dataType.elementType.simpleString(), known.schema["query"].dataType.simpleString()

        def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            number, weights, mean = sent.value
            names = np.array(list(number))
            running, now = Running(names, k), None
            asked, ended, blocks = [], [], []

            def finish() -> None:
                if not asked or not blocks:
                    return
                ids, at = np.unique(np.concatenate([b[1] for b in blocks]), return_inverse=True)
                alive = ~np.isin(ids, np.array(ended, dtype=ids.dtype))
                for a in range(0, len(asked), TILE):
                    some = np.array([number[q] for q in asked[a : a + TILE]])
                    place = np.full(len(names), -1)
                    place[some] = np.arange(len(some))
                    s, b = np.zeros((len(some), len(ids))), 0
                    for (field, term), keys, tf, size in blocks:
                        here, b = at[b : b + len(keys)], b + len(keys)
                        queries, w = weights[field, term]
                        row = place[queries]
                        row, w = row[row >= 0], w[row >= 0]
                        if len(row):
                            s[row[:, None], here] += w[:, None] * (tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / mean[field])))
                    s = s.round(9)  # sums of equal texts stay equal
                    q, d = np.nonzero((s > 0) & alive & (s >= running.edge[some][:, None]))  # all that tie with the k-th stay
                    running.add(pd.DataFrame({"query": names[some[q]], "id": ids[d], "score": s[q, d]}))

            for batch in batches:
                c = {n: batch.column(n) for n in batch.schema.names}
                where = zip(c["segment"].to_pylist(), c["range"].to_pylist(), strict=True)
                keys, tfs, sizes = (c[n].flatten().to_numpy(zero_copy_only=False) for n in ("keys", "tfs", "sizes"))
                n_keys, n_tf = (np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(c[n]), 0).to_numpy())) for n in ("keys", "tfs"))
                for i, (one, kind, query, field, term) in enumerate(zip(where, *(c[n].to_pylist() for n in ("kind", "query", "field", "term")), strict=True)):
                    if one != now:
                        finish()
                        now, asked, ended, blocks = one, [], [], []
                    if kind == 0:
                        asked.append(query)
                    elif kind == 1:
                        ended.extend(keys[n_keys[i] : n_keys[i + 1]].tolist())
                    else:
                        blocks.append(((field, term), keys[n_keys[i] : n_keys[i + 1]], tfs[n_tf[i] : n_tf[i + 1]].astype(float), sizes[n_tf[i] : n_tf[i + 1]]))
            finish()
            if (kept := running.cut()) is not None:
                yield pa.RecordBatch.from_pandas(kept[["query", "id", "score"]].rename(columns={"id": "key"}), preserve_index=False)

        names_of = ["segment", "range", "kind", "query", "field", "term", "keys", "tfs", "sizes"]
        none = {"query": F.lit(None).cast(query), "field": F.lit(None).cast("string"), "term": F.lit(None).cast("string"), "keys": F.lit(None).cast(f"array<{key}>"), "tfs": F.lit(None).cast("array<int>"), "sizes": F.lit(None).cast("array<int>")}

        def rows(df: DataFrame, kind: int) -> DataFrame:
            df = df.withColumn("kind", F.lit(kind))
            return df.select(*(F.col(n) if n in df.columns else none[n].alias(n) for n in names_of))

        def score(some: DataFrame, few: bool) -> DataFrame:
            blocks = live.join(F.broadcast(some.select("segment", "range").distinct()), ["segment", "range"], "left_semi") if few else live
            parts = rows(some.select("query", "segment", "range"), 0).unionByName(rows(blocks, 2))
            if (dead := self.store.read("dead", version)) is not None:
                for n, ranges in enumerate(version.note["ranges"]):
                    ended = dead.where(F.col("before") > n).select(F.lit(n).alias("segment"), _range(F.col("key"), ranges).alias("range"), F.array("key").alias("keys"))
                    parts = parts.unionByName(rows(ended, 1))
            parts = parts.repartition("segment", "range").sortWithinPartitions("segment", "range", "kind", "field", "term")
            return parts.mapInArrow(add_up, f"query {query}, key {key}, score double").withColumn("score", F.round("score", 9))

        return score

    def compact(self) -> Version:
        """All segments as one, without what is dead; rows of later searches stay the same."""
        now = self.store.latest()
        forward = self.store.write(self._live(self.store.read("forward", now), now).drop("segment"))
        rows = self.store.segment(forward)
        postings, ranges = self._put_blocks(rows, now.note)
        tables = {"forward": forward, "postings": postings, "terms": self._put_terms(postings), "totals": self.store.write(_totals(rows, 1)), "dead": ()}
        return self.store.commit(tables, note=now.note | {"ranges": [ranges]}, base=now)

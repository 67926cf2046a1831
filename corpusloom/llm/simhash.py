"""SimHash near-dedup with pigeonring filtering.

Fingerprints have 64 bits, in four segments of 16 that form a ring. If two differ in at
most 3 bits, then some segment begins a chain whose first segment differs in 0 bits, whose
first two differ in at most 1 and whose first three in at most 2: each prefix stays within
its share of the budget. Candidates meet on the first two segments of a chain (32 bits:
one side as they are, the other with one bit of the second segment turned), are pruned by
the third, and only then checked over all 64 bits.

Distinct fingerprints are the nodes, so any number of equal texts is one node. Each bucket
returns a spanning forest of its links, which keeps components exact without listing all
pairs of a group; buckets above ``MAX_BUCKET`` are divided by the same principle on the
bits that are left. Components come from alternating large-star and small-star rounds.

Defined results: a null text counts as empty; a text without words has fingerprint zero
and links like any other. The component id is the smallest non-null id reachable, null if
there is none. Repeated rows get one result each; other columns are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.scan import bounded_batches
from corpusloom.session import cut_lineage, fresh_name

SHINGLE, SEED, DISTANCE = 3, 42, 3
SEGMENTS, WIDTH = 4, 16
MAX_BUCKET = 2_048
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash of the lower-cased text's shingles of three words."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z and ASCII white space
    if not words:
        return 0
    line = b" ".join(words)
    n = max(len(words) - SHINGLE + 1, 1)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    starts = np.concatenate([[0], np.cumsum(sizes)])
    ends = (starts[SHINGLE : SHINGLE + n] - 1).tolist() if len(words) >= SHINGLE else [len(line)]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, dtype=np.int64)
    starts = starts[:n].tolist()
    for at in range(0, n, 65_536):
        h = np.array([digest(line[a:b], SEED) for a, b in zip(starts[at : at + 65_536], ends[at : at + 65_536], strict=True)], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprint_column(text: Column) -> Column:
    """The fingerprint as a signed long."""

    @F.pandas_udf("long")
    def fingerprints(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(x) for x in texts], dtype=np.uint64).view(np.int64))

    return fingerprints(text)


def _forest(fps: np.ndarray, left: int, shift: int) -> list[tuple[int, int]]:
    """Links within DISTANCE of distinct fingerprints, less those that close a circle.

    ``left``: bits in which they may still differ; ``shift``: the bucket's first segment,
    whose chain's third segment is the pigeonring's next filter.
    """
    n = len(fps)
    if n > MAX_BUCKET:
        return _divided(fps, left, shift)
    third = np.uint64(((1 << WIDTH) - 1) << (WIDTH * ((shift + 2) % SEGMENTS)))
    second = np.uint64(((1 << WIDTH) - 1) << (WIDTH * ((shift + 1) % SEGMENTS)))
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i in range(n - 1):
        x = fps[i + 1 :] ^ fps[i]
        near = np.flatnonzero(np.bitwise_count(x & (second | third)) <= 2)
        near = near[np.bitwise_count(x[near]) <= DISTANCE]
        for j in (near + i + 1).tolist():
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((int(fps[i]), int(fps[j])))
    return out


def _divided(fps: np.ndarray, left: int, shift: int) -> list[tuple[int, int]]:
    """A large bucket by pigeonhole on the bits in which its members may still differ.

    Of four parts of those bits one is equal in both members of a link, so all links are
    in one of the smaller buckets; each level fixes a quarter of the bits left, so the
    number of members falls below MAX_BUCKET while bits last.
    """
    bits = [b for b in range(64) if left >> b & 1]
    out = []
    for part in np.array_split(np.array(bits, dtype=np.uint64), DISTANCE + 1):
        mask = np.bitwise_or.reduce(np.uint64(1) << part) if len(part) else np.uint64(0)
        key = fps & mask
        order = np.argsort(key, kind="stable")
        for group in np.split(fps[order], np.flatnonzero(np.diff(key[order])) + 1):
            if len(group) > 1:
                out += _forest(group, left & ~int(mask), shift)
    return out


def _links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Spanning links of each bucket; rows come sorted by (shift, key), and a bucket may span batches."""
    open_: list[np.ndarray] = []  # what there is of the last bucket
    bucket: tuple[int, int] | None = None

    def closed(pieces: list[np.ndarray], shift: int) -> list[tuple[int, int]]:
        group = np.unique(pieces[0] if len(pieces) == 1 else np.concatenate(pieces))
        return _forest(group, int(_ALL), shift) if len(group) > 1 else []

    for batch in batches:
        if not len(batch):
            continue
        shift, key, fps = batch["shift"].to_numpy(), batch["key"].to_numpy(), batch["fp"].to_numpy().view(np.uint64)
        edges = [0, *(np.flatnonzero((np.diff(key) != 0) | (np.diff(shift) != 0)) + 1).tolist(), len(key)]
        out = []
        for a, b in zip(edges, edges[1:], strict=False):
            now = (int(shift[a]), int(key[a]))
            if now != bucket:
                if open_:
                    out += closed(open_, bucket[0])
                bucket, open_ = now, []
            open_.append(fps[a:b])
        if out:
            yield _pairs(out)
    if open_ and (out := closed(open_, bucket[0])):
        yield _pairs(out)


def _pairs(out: list[tuple[int, int]]) -> pd.DataFrame:
    return pd.DataFrame(np.array(out, dtype=np.uint64).view(np.int64).reshape(-1, 2), columns=["a", "b"])


def links(fps: DataFrame) -> DataFrame:
    """(a, b): spanning links among the distinct fingerprints of column ``fp``.

    A fingerprint goes to four buckets, one a rotation of the ring, and those whose second
    segment has an even number of ones also to the 16 buckets with one bit of it turned: of
    two that differ in one bit there, one is even and the other odd.
    """
    low = F.lit((1 << WIDTH) - 1)
    segment = lambda i: F.shiftrightunsigned("fp", WIDTH * (i % SEGMENTS)).bitwiseAND(low)
    rings = []
    for i in range(SEGMENTS):
        flips = F.array(F.lit(0), *[F.lit(1 << b) for b in range(WIDTH)])
        turned = F.when(F.bit_count(segment(i + 1)) % 2 == 0, flips).otherwise(F.array(F.lit(0)))
        rings.append(F.struct(F.lit(i).alias("shift"), segment(i).alias("first"), segment(i + 1).alias("second"), turned.alias("turned")))
    rows = fps.select("fp", F.explode(F.array(*rings)).alias("r")).select("fp", "r.*").select("fp", "shift", "first", "second", F.explode("turned").alias("turn"))
    keyed = rows.select(F.col("shift").cast("byte").alias("shift"), F.shiftleft("first", WIDTH).bitwiseOR(F.col("second").bitwiseXOR(F.col("turn"))).alias("key"), "fp")
    # A fingerprint alone in its bucket has no link: neighbours in order tell, in the same partitioning.
    order = Window.partitionBy("shift", "key").orderBy("fp")
    alone = F.lag("fp").over(order).isNull() & F.lead("fp").over(order).isNull()
    dealt = keyed.repartition("shift", "key").withColumn("alone", alone).where(~F.col("alone")).drop("alone").sortWithinPartitions("shift", "key")
    return dealt.mapInPandas(_links, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge: large-star and small-star rounds until nothing moves.

    A star's centre may have any number of leaves: its smallest neighbour is a pre-aggregated
    minimum, joined back to the edges, which Spark may split.
    """
    edges = cut_lineage(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a != b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        edges = cut_lineage(small.where("a != b").distinct())
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first())
        if state == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = state


def _grouped(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, sha, fp, root, component_id) of every row."""
    bounded_batches(docs.sparkSession)
    text = F.col("_text")
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    rows = cut_lineage(rows.select("_id", F.sha2(F.coalesce(text, F.lit("")), 256).alias("sha"), fingerprint_column(text).alias("fp")))
    nodes = rows.groupBy("fp").agg(F.min("_id").alias("first"))
    roots = components(links(nodes.select("fp")))
    member = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = member.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows.join(member.join(least, "root").select("fp", "root", "component_id"), "fp")


def near_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, fingerprint (hex), component_id."""
    rows = _grouped(docs, id_col, text_col)
    return rows.select(F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: the smallest id, nulls last, then the smallest text hash."""
    sha, key, nth = fresh_name(docs, "_sha"), fresh_name(docs, "_key"), fresh_name(docs, "_nth")
    whole_id = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))
    first = _grouped(docs, id_col, text_col).groupBy("root").agg(F.min(F.struct(F.col("_id").isNull(), "_id", "sha")).alias("s"))
    stays = first.select(whole_id(F.col("s._id")).alias(key), F.col("s.sha").alias(sha))
    rows = docs.withColumns({key: whole_id(F.col(id_col)), sha: F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)})
    left = rows.join(stays, [key, sha], "left_semi").withColumn(nth, F.row_number().over(Window.partitionBy(key, sha).orderBy(key)))
    return left.where(F.col(nth) == 1).select(*docs.columns)

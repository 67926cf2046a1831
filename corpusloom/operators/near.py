"""All pairs of near vectors, exact and without comparing all pairs.

Vectors are points on a sphere and nearness is an angle. Some of them, chosen from a bounded
sample, are pivots; every vector lives in the cell of its nearest pivot. By the triangle
inequality a vector can have a partner in another cell only if its angle to that pivot is
within the cell's radius and the wanted angle, and exceeds the angle to its own pivot by no
more than twice the wanted angle: only these cells it visits. Of two cells one is visited by
the other's vectors, so a pair meets once. Cells with many residents are divided into slices
that all visitors see. In its slice, a pair is bounded by the part of both vectors that lies
in the span of a few directions and the lengths of what is left (Cauchy and Schwarz), or, where
that takes over half of the directions, by a product in single precision and its error; pairs
whose bound reaches the threshold are compared in full. Equal vectors take part once, with a
list of members kept aside. Nothing is sampled or capped: no link is lost.

What pruning can do depends on the data: it is much for clustered vectors or narrow angles,
and little for random ones at wide angles, where every cell is near every vector.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Accumulator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.vectors import doubles, well_formed, width
from corpusloom.session import cut_lineage

RESIDENTS, MOST_RESIDENTS, SLICES = 4_096, 49_152, 32  # of a slice: so many, or up to the second number where there are more slices than the third
MAX_PIVOTS, SAMPLE = 1_024, 8_192
TILE = 64
PAIRS = 16_384  # compared in full at a time
DEALT = 16_384  # rows that a task deals to slices at a time
EPS = 1e-9


@dataclass
class JoinReport:
    """Counts of a join, valid once its rows have been computed: distinct vectors, visits to slices, bounded and fully compared pairs."""

    visits: Accumulator
    bounded: Accumulator
    compared: Accumulator
    vectors: int = 0
    cells: int = 0
    slices: int = 0

    @classmethod
    def of(cls, spark) -> JoinReport:
        return cls(*(spark.sparkContext.accumulator(0) for _ in range(3)))


def unit(v: pd.Series) -> np.ndarray:
    m = np.stack(v.to_list()).astype(float)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def spread_pivots(sample: np.ndarray, k: int) -> np.ndarray:
    """k rows far from each other: each next one is that with the largest angle to all before it."""
    chosen, nearest = [0], sample @ sample[0]
    while len(chosen) < min(k, len(sample)):
        at = int(nearest.argmin())
        if nearest[at] > 1 - 1e-12:
            break  # all others equal a pivot
        chosen.append(at)
        nearest = np.maximum(nearest, sample @ sample[at])
    return sample[chosen]


def directions(sample: np.ndarray, n: int) -> np.ndarray:
    """The n orthonormal directions in which the sample spreads most."""
    return np.linalg.svd(sample, full_matrices=False)[2][:n].T


def _angles(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(v @ pivots.T, -1, 1))


def _partners(left: np.ndarray, right: np.ndarray, basis: np.ndarray, threshold: float, report: tuple[Accumulator, Accumulator]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of left, row of right, cosine) of pairs at the threshold or above."""
    bounded, compared = report
    size = right.shape[1]
    single = 2 * basis.shape[1] > size
    if single:
        pr, least = right.astype(np.float32).T.copy(), np.float32(threshold - 1e-6 - 1.2e-7 * size)  # products of units err by less
    else:
        pr = right @ basis
        rest_r = np.sqrt(np.maximum(0, 1 - (pr**2).sum(1)))
    for a in range(0, len(left), TILE):
        some = left[a : a + TILE]
        if single:
            x, y = np.divmod(np.flatnonzero(some.astype(np.float32) @ pr >= least), len(right))
        else:
            pl = some @ basis
            rest_l = np.sqrt(np.maximum(0, 1 - (pl**2).sum(1)))
            x, y = np.nonzero(pl @ pr.T + np.outer(rest_l, rest_r) >= threshold - EPS)
        bounded.add(len(some) * len(right))
        compared.add(len(x))
        for b in range(0, len(x), PAIRS):
            s = np.einsum("ij,ij->i", some[x[b : b + PAIRS]], right[y[b : b + PAIRS]])
            keep = s >= threshold - 1e-12
            yield a + x[b : b + PAIRS][keep], y[b : b + PAIRS][keep], s[keep]


def distinct_vectors(df: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, DataFrame | None]:
    """(id, v, n): one row for equal vectors, with their smallest id; and members (id, member) of those that are more than one, if any."""
    rows = well_formed(df, vec_col, width(df, vec_col)).select(F.col(id_col).cast("long").alias("member"), doubles(F.col(vec_col)).alias("v"))
    once = cut_lineage(rows.groupBy("v").agg(F.min("member").alias("id"), F.count("*").alias("n")))
    several = once.where("n > 1").select("v", "id")
    return once.select("id", "v", "n"), None if several.isEmpty() else cut_lineage(rows.join(several, "v").select("id", "member"))


def _meet(basis: np.ndarray, threshold: float, counts: tuple[Accumulator, Accumulator]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Rows (slice, kind, id, v) by slice, residents (kind 0) before visitors: residents are held and meet each other, then visitors pass."""

    def pairs(a: np.ndarray, b: np.ndarray, s: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "score": s})

    def among(ids: np.ndarray, held: np.ndarray) -> Iterator[pd.DataFrame]:
        for x, y, s in _partners(held, held, basis, threshold, counts):
            keep = x < y
            yield pairs(ids[x[keep]], ids[y[keep]], s[keep])

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, ids, held, whole = None, [], [], True
        for batch in batches:
            for (at, kind), some in batch.groupby(["slice", "kind"], sort=True):
                if not whole and (at != now or kind):
                    ids, held, whole = [np.concatenate(ids)], [np.concatenate(held)], True
                    yield from among(ids[0], held[0])
                if at != now:
                    now, ids, held = at, [], []
                if kind == 0:
                    ids.append(some["id"].to_numpy())
                    held.append(unit(some["v"]))
                    whole = False
                elif held:
                    for x, y, s in _partners(unit(some["v"]), held[0], basis, threshold, counts):
                        yield pairs(some["id"].to_numpy()[x], ids[0][y], s)
        if not whole:
            yield from among(np.concatenate(ids), np.concatenate(held))

    return meet


class _Fold:
    """What a slice's pairs say of groups: links that connect as they do, and sums at one end of each pair."""

    def __init__(self, ids: np.ndarray, copies: np.ndarray) -> None:
        self.ids, self.copies = ids, copies
        self.group = np.arange(len(ids))  # of each resident, the smallest place in it
        self.sums, self.pairs = np.zeros((2, len(ids)))

    def add(self, x: np.ndarray, y: np.ndarray, s: np.ndarray, copies: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of others x (by ``copies``) and residents y; returns each x once, and a resident that it meets."""
        n = copies[x] * self.copies[y]
        self.sums += np.bincount(y, n * s, minlength=len(self.ids))
        self.pairs += np.bincount(y, n, minlength=len(self.ids))
        one, at, where = np.unique(x, return_index=True, return_inverse=True)
        self.link(y[at][where], y)
        return one, y[at]

    def link(self, x: np.ndarray, y: np.ndarray) -> None:
        while len(differ := np.flatnonzero(self.group[x] != self.group[y])):
            p, q = self.group[x[differ]], self.group[y[differ]]
            np.minimum.at(self.group, np.maximum(p, q), np.minimum(p, q))
            while (self.group[self.group] != self.group).any():
                self.group = self.group[self.group]

    def told(self) -> pd.DataFrame:
        met = np.flatnonzero((self.pairs > 0) | (self.group != np.arange(len(self.ids))))
        return pd.DataFrame({"a": self.ids[met], "b": self.ids[self.group[met]], "sum": self.sums[met], "pairs": self.pairs[met].astype(np.int64)})


def _fold(basis: np.ndarray, threshold: float, counts: tuple[Accumulator, Accumulator]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Rows as for ``_meet``, with copies; gives (a, b, sum, pairs) of groups instead of pairs, a few rows for each vector of a slice."""

    def start(parts: list[pd.DataFrame]) -> tuple[_Fold, np.ndarray]:
        held, v = _Fold(*(np.concatenate([p[c].to_numpy() for p in parts]) for c in ("id", "n"))), np.concatenate([unit(p["v"]) for p in parts])
        for x, y, s in _partners(v, v, basis, threshold, counts):
            keep = x < y
            if keep.any():
                held.link(x[keep], y[keep])
                held.add(x[keep], y[keep], s[keep], held.copies)
        return held, v

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, parts, held, v = None, [], None, None
        for batch in batches:
            for (at, kind), some in batch.groupby(["slice", "kind"], sort=True):
                if at != now:
                    if parts:
                        held, v = start(parts)
                    if held is not None:
                        yield held.told()
                    now, parts, held, v = at, [], None, None
                if kind == 0:
                    parts.append(some)
                    continue
                if parts:
                    held, v, parts = *start(parts), []
                if held is None:
                    continue
                ids, copies = some["id"].to_numpy(), some["n"].to_numpy()
                for x, y, s in _partners(unit(some["v"]), v, basis, threshold, counts):
                    if len(x):
                        one, met = held.add(x, y, s, copies)
                        yield pd.DataFrame({"a": ids[one], "b": held.ids[met], "sum": 0.0, "pairs": 0})
        if parts:
            held, _ = start(parts)
        if held is not None:
            yield held.told()

    return fold


def near_pairs(rows: DataFrame, threshold: float, *, residents: int | None = None, pivots: int = MAX_PIVOTS, report: JoinReport | None = None, fold: bool = False) -> DataFrame:
    """(a, b, score) with a < b of all pairs of (id, v) with a cosine of at least ``threshold``; vectors are not zero.

    ``rows`` are read several times: a stored or checkpointed table. ``residents`` bounds what a task holds (``RESIDENTS`` by default, up to ``MOST_RESIDENTS`` of very many vectors, which then visit fewer slices); pivots are one for so many rows, ``pivots`` at most.
    With ``fold``, of rows (id, v, n: its copies), links and sums in place of pairs: see ``group_sums``.
    """
    spark = rows.sparkSession
    report = report or JoinReport.of(spark)
    schema = "a long, b long, sum double, pairs long" if fold else "a long, b long, score double"
    extra, extra_type = (["n"], ", n long") if fold else ([], "")
    meet = _fold if fold else _meet
    n = rows.count()
    report.vectors = n
    residents = residents or min(MOST_RESIDENTS, max(RESIDENTS, -(-n // SLICES)))
    if n < 2:
        return rows.select(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), *((F.lit(0.0).alias("sum"), F.lit(0).cast("long").alias("pairs")) if fold else (F.lit(0.0).alias("score"),))).limit(0)
    share = min(1.0, SAMPLE / n)
    picked = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) <= int(share * (1 << 30))).orderBy(F.xxhash64("id"), "id").limit(2 * SAMPLE).toPandas()
    if not len(picked):
        picked = rows.limit(1).toPandas()
    sample = unit(picked["v"])
    middle = spread_pivots(sample, max(1, min(pivots, -(-n // residents))))
    width_ = sample.shape[1]
    basis = directions(sample, max(1, min(width_, math.ceil(width_ * (1.15 - threshold)))))
    wanted = math.acos(max(-1.0, min(1.0, threshold))) + EPS
    sent = spark.sparkContext.broadcast(middle)

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                angle = _angles(unit(batch["v"]), sent.value)
                home = angle.argmin(1)
                yield pd.DataFrame({"id": batch["id"], "v": batch["v"], **{c: batch[c] for c in extra}, "home": home, "angle": angle[np.arange(len(batch)), home]})

    if n <= residents:  # all vectors are one slice
        report.cells = report.slices = 1
        one = rows.select(F.lit(0).cast("long").alias("slice"), F.lit(0).alias("kind"), "id", "v", *extra).coalesce(1)
        return one.mapInPandas(meet(basis, threshold, (report.bounded, report.compared)), schema)
    homes = cut_lineage(rows.mapInPandas(settle, f"id long, v array<double>{extra_type}, home int, angle double"))
    told = homes.groupBy("home").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).collect()  # a row a pivot
    size, radius = np.zeros(len(middle), dtype=np.int64), np.full(len(middle), -np.inf)
    for r in told:
        size[r["home"]], radius[r["home"]] = r["n"], r["radius"]
    slices = np.maximum(1, -(-size // residents))
    first = np.concatenate([[0], np.cumsum(slices)])
    report.cells, report.slices = int((size > 0).sum()), int(slices[size > 0].sum())
    seen = report.visits

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells = np.arange(len(size))
        some = max(1, DEALT // int(first[-1]))  # a vector visits every slice at most
        for batch in (whole.iloc[a : a + some] for whole in batches for a in range(0, len(whole), some)):
            v, home, ids = unit(batch["v"]), batch["home"].to_numpy(), batch["id"].to_numpy()
            own = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % slices[home]
            angle = _angles(v, sent.value)
            low, high = np.minimum(home[:, None], cells[None]), np.maximum(home[:, None], cells[None])
            host = np.where((low + high) % 2 == 0, low, high)  # of two cells, the one that is visited
            go = (host == cells) & (cells != home[:, None]) & (size > 0)
            go &= (angle <= radius + wanted) & (angle - angle[np.arange(len(v)), home][:, None] <= 2 * wanted)
            row, cell = np.nonzero(go)
            times = slices[cell]
            at = np.repeat(first[cell], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            inner = np.concatenate([np.zeros(0, dtype=np.int64), *(first[h] + np.arange(o) for h, o in zip(home, own, strict=True))])  # earlier slices of its own cell
            to = np.concatenate([first[home] + own, inner, at]).astype(np.int64)
            who = np.concatenate([np.arange(len(v)), np.repeat(np.arange(len(v)), own), np.repeat(row, times)])
            seen.add(len(to) - len(v))
            yield pd.DataFrame({"slice": to, "kind": (np.arange(len(to)) >= len(v)).astype(np.int32), "id": ids[who], "v": batch["v"].to_numpy()[who], **{c: batch[c].to_numpy()[who] for c in extra}})

    dealt = homes.mapInPandas(deal, f"slice long, kind int, id long, v array<double>{extra_type}")
    dealt = dealt.repartition(int(min(max(first[-1], 1), 20_000)), "slice").sortWithinPartitions("slice", "kind")
    return dealt.mapInPandas(meet(basis, threshold, (report.bounded, report.compared)), schema)


def similar_groups(df: DataFrame, threshold: float, *, id_col: str = "vec_id", vec_col: str = "embedding", residents: int | None = None, report: JoinReport | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Pairs (a, b, score) of different vectors by their smallest ids, and members (id, member) of equal ones, if any: whole, and never quadratic in copies."""
    once, members = distinct_vectors(df, id_col, vec_col)
    return near_pairs(once, threshold, residents=residents, report=report), members


def similar_pairs(df: DataFrame, threshold: float, *, id_col: str = "vec_id", vec_col: str = "embedding", residents: int | None = None, report: JoinReport | None = None) -> DataFrame:
    """(a, b, score) of all pairs a < b with a cosine of at least ``threshold``, copies written out.

    Zero, ragged and odd vectors have no pairs. A large group of equal vectors makes as many rows
    as it has pairs; ``similar_groups`` says the same without them.
    """
    found, members = similar_groups(df, threshold, id_col=id_col, vec_col=vec_col, residents=residents, report=report)
    if members is None:
        return found
    every = lambda side: members.select(F.col("id").alias(side), F.col("member").alias(f"_{side}"))
    wide = found.join(every("a"), "a", "left").join(every("b"), "b", "left")
    x, y = F.coalesce("_a", "a"), F.coalesce("_b", "b")
    different = wide.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"), "score")
    if threshold > 1:
        return different
    m = members.select("id", F.col("member").alias("a")).join(members.select("id", F.col("member").alias("b")), "id").where("a < b")
    return different.unionByName(m.select("a", "b", F.lit(1.0).alias("score")))


def group_sums(df: DataFrame, threshold: float, *, id_col: str = "vec_id", vec_col: str = "embedding", residents: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Groups of all pairs at the threshold, without a row for each pair: links (a, b, sum, pairs) and nodes (node, size).

    The links connect what the pairs connect, by smallest ids of equal vectors; ``sum`` and ``pairs`` add up cosines and
    numbers of pairs that belong to the group of a. ``size`` counts the copies of a node. Every pair is compared and
    counted; what is sent on are a few rows for each vector and slice that it visits.
    """
    once, _ = distinct_vectors(df, id_col, vec_col)
    links = near_pairs(once, threshold, residents=residents, fold=True)
    n = F.col("n")
    own = once.where(n > 1).select(F.col("id").alias("a"), F.col("id").alias("b"), (n * (n - 1) / 2).alias("sum"), (n * (n - 1) / 2).cast("long").alias("pairs"))
    return links.unionByName(own) if threshold <= 1 else links, once.select(F.col("id").alias("node"), n.alias("size"))

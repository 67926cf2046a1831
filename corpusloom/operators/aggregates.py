"""Stored aggregates that follow their table by signed deltas.

For every dimension of the rows (a category, each tag, a month, ...) and each of its values
the number of rows and sums of measures are kept. Because values have their number of rows,
a value that no row has any more is gone: distinct counts, smallest and largest values and
histograms can shrink as well as grow. A delta is the same kind of table with signs, made of
the changed rows alone, and is appended as a segment; reading adds segments up, and they are
merged into one when they have become many.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.sources.snapshots import SnapshotStore, Version


class StoredAggregate:
    """Counts and sums by dimension and value, in a folder.

    ``dimensions`` give a value or an array of values for a row (nulls count nowhere);
    ``measures`` are summed. Sums of decimals and integers are exact whatever the order;
    those of doubles are as exact as doubles are.
    """

    def __init__(self, spark: SparkSession, folder: str, dimensions: dict[str, Column], measures: dict[str, Column], *, most_segments: int = 16) -> None:
        self.store, self.dimensions, self.measures, self.most = SnapshotStore(spark, folder), dimensions, measures, most_segments

    def signed(self, rows: DataFrame, sign: int = 1) -> DataFrame:
        """(dimension, value, n, measures): what the rows add, or take away; '' stands for all rows.

        One pass and one shuffle: a row is exploded into its dimensions' values, summed before it.
        """
        kind = rows.select(*(c.alias(name) for name, c in self.dimensions.items())).schema
        listed = lambda name, c: c.cast("array<string>") if kind[name].dataType.typeName() == "array" else F.array(c.cast("string"))
        named = lambda name: lambda v: F.struct(F.lit(name).alias("dimension"), v.alias("value"))
        parts = [F.array(F.struct(F.lit("").alias("dimension"), F.lit("").alias("value")))]
        parts += [F.transform(F.coalesce(F.array_distinct(listed(name, c)), F.array().cast("array<string>")), named(name)) for name, c in self.dimensions.items()]
        own = {m: F.coalesce(c, F.lit(0)) for m, c in self.measures.items()}
        one = rows.select(*(c.alias(f"_m_{m}") for m, c in own.items()), F.explode(F.concat(*parts)).alias("_d"))
        return one.where("_d.value IS NOT NULL").groupBy(F.col("_d.dimension").alias("dimension"), F.col("_d.value").alias("value")).agg((sign * F.count("*")).alias("n"), *((sign * F.sum(f"_m_{m}")).alias(m) for m in self.measures))

    def rebuild(self, rows: DataFrame) -> Version:
        return self.store.commit({"sums": self.signed(rows)}, note={"batch": -1})

    def apply(self, added: DataFrame | None, removed: DataFrame | None = None, *, batch: int | None = None) -> Version:
        """Takes in added rows and the images of removed ones. A ``batch`` that is in already changes nothing."""
        now = self.store.latest()
        if now is not None and batch is not None and now.note.get("batch", -1) >= batch:
            return now
        delta = None
        for rows, sign in ((added, 1), (removed, -1)):
            one = None if rows is None else self.signed(rows, sign)
            delta = one if delta is None else delta if one is None else delta.unionByName(one)
        note = {"batch": batch if batch is not None else (now.note.get("batch", -1) if now else -1)}
        if now is not None and len(now.tables.get("sums", ())) >= self.most:
            return self.store.commit({"sums": self._added_up(self.store.read("sums", now).drop("segment").unionByName(delta))}, note=note, base=now)
        return self.store.commit(add={"sums": delta}, note=note, base=now)

    def apply_batch(self, changes: DataFrame, number: int) -> None:
        """For ``foreachBatch``: changes have a ``sign``, 1 for a row that came and -1 for the image of one that went."""
        changes = changes.persist()  # read twice
        self.apply(changes.where("sign = 1"), changes.where("sign = -1"), batch=number)
        changes.unpersist()

    def _added_up(self, rows: DataFrame) -> DataFrame:
        sums = rows.groupBy("dimension", "value").agg(F.sum("n").alias("n"), *(F.sum(m).alias(m) for m in self.measures))
        return sums.where((F.col("n") != 0) | (F.col("dimension") == ""))

    def values(self, dimension: str | None = None) -> DataFrame:
        """(dimension, value, n, measures) of the values that rows have; of one dimension if named. Reads the sums only."""
        rows = self.store.read("sums")
        if rows is None:
            raise ValueError("nothing is stored: rebuild first")
        rows = rows if dimension is None else rows.where(F.col("dimension") == dimension)
        return self._added_up(rows.drop("segment")).where("n <> 0" if dimension != "" else "true")

    def totals(self, *, distinct: tuple[str, ...] = (), span: dict[str, str] | None = None) -> DataFrame:
        """One row: n, the measures, how many values a dimension has, and first and last of dimensions cast to a type (``span``)."""
        rows = self.values().unionByName(self.values("").where("n = 0"))
        at = lambda d: F.col("dimension") == d
        one = [F.coalesce(F.sum(F.when(at(""), F.col("n"))), F.lit(0)).alias("n"), *(F.sum(F.when(at("") & (F.col("n") != 0), F.col(m))).alias(m) for m in self.measures)]
        one += [F.count_if(at(d)).alias(f"{d}_values") for d in distinct]
        for d, kind in (span or {}).items():
            one += [f(F.when(at(d), F.col("value").cast(kind))).alias(f"{name}_{d}") for name, f in (("first", F.min), ("last", F.max))]
        return rows.agg(*one)

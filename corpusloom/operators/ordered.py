"""Windows over ordered histories of keys of which one may hold most rows.

A window over a key's rows runs in one task. Here a history is cut into stretches, and a
stretch takes along what its first windows reach back to (a halo), so that a key is as many
window partitions as its history asks for, with the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from corpusloom.session import cut_lineage, fresh_name

STRETCH = 20_000


def numbered_in_keys(df: DataFrame, key: str, order: list[str], name: str = "nth", *, parts: int | None = None) -> DataFrame:
    """``df`` with the number of each row (from 0) in its key's order, without a task for a whole key.

    Rows are range-partitioned by key and order, written, and counted by part; a row's number is
    what earlier parts have of its key, and its place in its part. ``order`` should tell a key's
    rows apart: rows that it does not tell apart share a part.
    """
    part, place = fresh_name(df, "_part"), fresh_name(df, "_before")
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = cut_lineage(df.repartitionByRange(n, key, *order).withColumn(part, F.spark_partition_id()))
    counts = rows.groupBy(key, part).agg(F.count("*").alias("_c"))  # a row for a key and part
    before = counts.select(F.col(key).alias("_key"), F.col(part).alias("_at"), (F.sum("_c").over(Window.partitionBy(key).orderBy(part)) - F.col("_c")).alias(place))
    placed = rows.join(before, rows[key].eqNullSafe(F.col("_key")) & (F.col(part) == F.col("_at")))
    nth = F.col(place) + F.row_number().over(Window.partitionBy(part, key).orderBy(*order)) - 1
    return placed.withColumn(name, nth).drop(part, place, "_key", "_at")


def over_last_rows(df: DataFrame, key: str, order: list[str], back: int, columns: Callable[[WindowSpec], dict[str, Column]], *, stretch: int = STRETCH, parts: int | None = None) -> DataFrame:
    """``df`` with columns over each row and the ``back`` rows before it in its key's order.

    ``columns`` gets the window. A stretch has ``stretch`` rows, or four times ``back`` if that is
    more, and ``back`` rows of the one before it.
    """
    length = max(stretch, 4 * back, 1)
    nth, at, own = (fresh_name(df, c) for c in ("_nth", "_stretch", "_own"))
    rows = numbered_in_keys(df, key, order, nth, parts=parts)
    home = F.floor(F.col(nth) / length)
    on = F.floor((F.col(nth) + back) / length)
    rows = rows.withColumn(at, F.explode(F.sequence(home, on))).withColumn(own, F.col(at) == home)
    w = Window.partitionBy(key, at).orderBy(nth).rowsBetween(-back, 0)
    return rows.select("*", *(c.alias(name) for name, c in columns(w).items())).where(F.col(own)).drop(nth, at, own)


def over_last_stretch(df: DataFrame, key: str, order: str, back: float, columns: Callable[[WindowSpec], dict[str, Column]]) -> DataFrame:
    """``df`` with columns over each row and its key's rows with an ``order`` of at most ``back`` less.

    The order is a number (seconds), looked at in millionths. It is cut into stretches of ``back``,
    and a row is looked at in its own and the next one; rows without an order are together.
    """
    at, own, fine = (fresh_name(df, c) for c in ("_stretch", "_own", "_fine"))
    reach = max(1, round(back * 1e6))
    rows = df.withColumn(fine, F.round(F.col(order) * 1e6).cast("long"))
    home = F.floor(F.col(fine) / reach)
    rows = rows.withColumn(at, F.explode_outer(F.when(F.col(fine).isNotNull(), F.array(home, home + 1)))).withColumn(own, F.coalesce(F.col(at) == home, F.lit(True)))
    w = Window.partitionBy(key, at).orderBy(fine).rangeBetween(-reach, 0)
    return rows.select("*", *(c.alias(name) for name, c in columns(w).items())).where(F.col(own)).drop(at, own, fine)


def within_after(events: DataFrame, marks: DataFrame, key: str, order: str, seconds: float, name: str) -> DataFrame:
    """``events`` with whether a mark (key, order) of the same key stands at most, but not exactly, ``seconds`` before, or at, a row.

    The last mark up to a row decides. Marks and rows meet in one ordered window for each key
    and stretch of ``seconds``, so nothing is compared pair by pair.
    """
    at, mark = (fresh_name(events, c) for c in ("_stretch", "_mark"))
    home = F.floor(F.col(order) / seconds)
    m = marks.where(F.col(key).isNotNull() & F.col(order).isNotNull()).select(key, order).distinct()
    m = m.withColumn(at, F.explode(F.array(home, home + 1))).withColumn(mark, F.col(order))
    rows = events.withColumn(at, home).unionByName(m, allowMissingColumns=True)
    rows = rows.withColumn("_event", F.col(mark).isNull())
    last = F.max(mark).over(Window.partitionBy(key, at).orderBy(order).rangeBetween(Window.unboundedPreceding, 0))
    found = F.coalesce(F.col(order) < last + seconds, F.lit(False))
    return rows.withColumn(name, found).where("_event").drop(at, mark, "_event")


def head_batches(queue: DataFrame, kind: Column, most: dict[str, int], order: list[str], *, by: str = "queue", other: int = 1) -> DataFrame:
    """``queue`` with ``batch`` (from 1) in which each row of a queue (``by``) is worked on, and its ``kind``.

    The run of one kind at the head is the next batch, ``most`` of its kind's rows at most
    (``other`` for kinds that are not named), and so on: runs are islands of the queue's order, so
    batches follow from places without taking rows off one by one. A null kind is one of its own.
    """
    w = Window.partitionBy(by).orderBy(*order)
    rows = queue.withColumn("kind", kind)
    last = F.lag("kind").over(w)
    rows = rows.withColumn("_new", (F.row_number().over(w) == 1) | ~F.col("kind").eqNullSafe(last))
    rows = rows.withColumn("_run", F.sum(F.col("_new").cast("int")).over(w))
    size = F.lit(other)
    for name, n in most.items():
        size = F.when(F.col("kind") == name, n).otherwise(size)
    place = F.row_number().over(Window.partitionBy(by, "_run").orderBy(*order)) - 1
    rows = rows.withColumn("_first", (place % size == 0).cast("int"))
    return rows.withColumn("batch", F.sum("_first").over(w)).drop("_new", "_run", "_first")


def append_in_order(stored: DataFrame, new: DataFrame, key: str, order: list[str], place: str = "sort_order") -> DataFrame:
    """The ``new`` rows with the places that follow the largest stored one of their key, by their order; a key's first place is 1."""
    last = stored.groupBy(key).agg(F.max(place).alias("_last"))
    nth = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return new.join(last, key, "left").withColumn(place, (F.coalesce("_last", F.lit(0)) + nth).cast("long")).drop("_last")

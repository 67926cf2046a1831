"""Stateful streams whose rows do not depend on how events are cut into micro-batches.

Events wait in the state store until the watermark has passed them and are then taken in the
order of their time, one key after another, by event-time timers. The same step in a fold
over a finished table is the batch twin. Rows later than the watermark are dropped by Spark,
which counts them (``numRowsDroppedByWatermark``). These streams need the RocksDB state
store: ``spark.sql.streaming.stateStore.providerClass``, see ``ROCKSDB``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from corpusloom.operators.folds import fold_in_order

#: Setting and value that these streams need.
ROCKSDB = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _seconds(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp")) / 1e6


# Moves: deletes that wait for an add of the same file.


@dataclass(frozen=True)
class MoveRule:
    """``tolerance_s`` between modification times, ``window_s`` that a delete waits, ``most`` deletes that wait at a time for one size and extension."""

    tolerance_s: float = 2.0
    window_s: float = 5.0
    most: int = 200

    def expire(self, held: list[tuple], s: float) -> tuple[list[tuple], list[tuple]]:
        """Waiting deletes (id, base, path, s, mtime) that are left at s, and rows of those whose time is up."""
        gone = [h for h in held if h[3] + self.window_s <= s]
        return [h for h in held if h[3] + self.window_s > s], [(h[0], None, "gone", h[3] + self.window_s) for h in gone]

    def step(self, held: list[tuple], id_: int, kind: str, path: str, s: float, mtime: float) -> tuple[list[tuple], list[tuple]]:
        held, out = self.expire(held, s)
        base = path.rsplit("/", 1)[-1].lower()
        if kind == "delete":
            again = next((n for n, h in enumerate(held) if h[2] == path), None)
            if again is not None:  # a newer delete of the same path takes the place of the one that waits
                out.append((held[again][0], None, "replaced", s))
                return [*held[:again], *held[again + 1 :], (id_, base, path, s, mtime)], out
            if len(held) >= self.most:
                out.append((held[0][0], None, "evicted", s))
                held = held[1:]
            return [*held, (id_, base, path, s, mtime)], out
        near = [h for h in held if abs(h[4] - mtime) <= self.tolerance_s]
        if len(near) > 1:
            near = [h for h in near if h[1] == base]
        if len(near) == 1 and near[0][2] != path:
            out.append((near[0][0], id_, "moved", s))
            held = [h for h in held if h is not near[0]]
        return held, out


MOVES = "deleted long, added long, outcome string, s double"


def _file_key() -> Column:
    ext = F.lower(F.regexp_extract(F.element_at(F.split("path", "/"), -1), r".(\.[^.]*)$", 1))
    return F.concat_ws("|", F.col("size").cast("string"), ext)


def correlated_moves(events: DataFrame, rule: MoveRule = MoveRule()) -> DataFrame:
    """(deleted, added, outcome, s): what became of the deletes among file events (id, kind, path, size, ts, mtime).

    kind is add or delete, mtime the modification time in seconds. A delete is ``moved`` if an
    add of the same size and extension with a modification time in tolerance comes while it
    waits; of several such deletes only one of the add's base name is taken. It is ``gone`` when
    its time is up, ``evicted`` when too many wait, ``replaced`` by another delete of its path.
    """

    def step(held, id_, kind, path, s, mtime):
        return rule.step(held, id_, kind, path, s, mtime)

    e = events.select(_file_key().alias("file"), "id", "kind", "path", _seconds("ts").alias("s"), "mtime")
    rows = fold_in_order(e, "file", ["s", "id"], ["id", "kind", "path", "s", "mtime"], f"file string, {MOVES}", start=list, step=step, finish=lambda held: rule.expire(held, math.inf)[1])
    return rows.drop("file")


class _Moves(StatefulProcessor):
    def __init__(self, rule: MoveRule) -> None:
        self.rule = rule

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "id long, kind string, path string, s double, mtime double")
        self.held = handle.getListState("held", "id long, base string, path string, s double, mtime double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            self.waiting.appendList(list(batch[["id", "kind", "path", "s", "mtime"]].itertuples(index=False, name=None)))
            for ms in {math.floor(s * 1000) + 1 for s in batch["s"]}:
                self.handle.registerTimer(max(ms, timerValues.getCurrentWatermarkInMs() + 1))
        yield _frame([], ["deleted", "added", "outcome", "s"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs() / 1000
        rows, held, out = list(self.waiting.get()), list(self.held.get()), []
        due = sorted((r for r in rows if r[3] < now), key=lambda r: (r[3], r[0]))
        for id_, kind, path, s, mtime in due:
            held, new = self.rule.step(held, id_, kind, path, s, mtime)
            out += new
        held, new = self.rule.expire(held, now)
        _put(self.waiting, [r for r in rows if r[3] >= now])
        _put(self.held, held)
        for h in held:
            self.handle.registerTimer(math.ceil((h[3] + self.rule.window_s) * 1000))
        yield _frame(out + new, ["deleted", "added", "outcome", "s"])

    def close(self) -> None:
        pass


def _frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    """Plain objects: Arrow-backed columns come as chunks, which the state's serializer does not take."""
    return pd.DataFrame({c: pd.Series([r[n] for r in rows], dtype=object) for n, c in enumerate(columns)})


def _put(state, rows: list[tuple]) -> None:
    if rows:
        state.put(rows)
    else:
        state.clear()


def correlated_moves_stream(events: DataFrame, rule: MoveRule = MoveRule(), *, watermark: str = "10 seconds") -> DataFrame:
    """``correlated_moves`` of a stream; what waits for a size and extension is at most ``rule.most`` deletes in the state store."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark).select(_file_key().alias("file"), "ts", "id", "kind", "path", _seconds("ts").alias("s"), "mtime")
    return e.groupBy("file").transformWithStateInPandas(_Moves(rule), MOVES, "Append", "EventTime")


# Queues: the latest row of each key, taken off by ticks.


@dataclass(frozen=True)
class QueueRule:
    """Every ``tick_s`` the ``size`` oldest rows leave. A queue holds ``capacity`` keys: a new one beyond drops the ``oldest`` or is itself refused (``newest``)."""

    size: int = 50
    tick_s: float = 0.5
    capacity: int = 500
    overflow: str = "oldest"

    def tick(self, s: float) -> int:
        return math.floor(s / self.tick_s)

    def drain(self, held: dict[str, int], last: int, tick: int | None) -> tuple[dict[str, int], list[tuple]]:
        """What is held after the ticks from ``last`` to ``tick`` (None: all there will be), and the rows that left."""
        items = list(held.items())
        n = len(items) if tick is None else min(len(items), max(0, tick - last) * self.size)
        return dict(items[n:]), [(id_, "flushed", last + 1 + k // self.size) for k, (_, id_) in enumerate(items[:n])]

    def step(self, held: dict[str, int], tick: int, key: str | None, id_: int, valid: bool) -> tuple[dict[str, int], list[tuple]]:
        if key is None or not valid:
            return held, [(id_, "failed", tick)]
        if key in held:  # the later row takes the earlier one's place
            return {**held, key: id_}, [(held[key], "replaced", tick)]
        if len(held) < self.capacity:
            return {**held, key: id_}, []
        if self.overflow == "newest":
            return held, [(id_, "refused", tick)]
        first = next(iter(held))
        return {k: v for k, v in held.items() if k != first} | {key: id_}, [(held[first], "dropped", tick)]


QUEUE = "id long, outcome string, tick long"


def queued(items: DataFrame, rule: QueueRule = QueueRule(), *, valid: Column | None = None) -> DataFrame:
    """(queue, id, outcome, tick): what became of every item (queue, key, id, ts), and in which tick.

    ``flushed``, ``replaced`` by a later item of its key, ``dropped`` or ``refused`` when the
    queue was full, ``failed`` if it has no key or is not ``valid``: every item comes out once.
    """

    def step(state, s, id_, key, ok):
        held, last = state
        tick = rule.tick(s)
        held, out = rule.drain(held, tick if last is None else last, tick)
        held, new = rule.step(held, tick, key, id_, bool(ok))
        return (held, tick), out + new

    ok = F.lit(True) if valid is None else F.coalesce(valid, F.lit(False))
    e = items.select("queue", "id", "key", _seconds("ts").alias("s"), ok.alias("ok"))
    return fold_in_order(e, "queue", ["s", "id"], ["s", "id", "key", "ok"], f"queue string, {QUEUE}", start=lambda: ({}, None), step=step, finish=lambda state: rule.drain(state[0], state[1], None)[1])


class _Queue(StatefulProcessor):
    def __init__(self, rule: QueueRule) -> None:
        self.rule = rule

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "s double, id long, key string, ok boolean")
        self.held = handle.getListState("held", "key string, id long")
        self.last = handle.getValueState("last", "tick long")

    def _at(self, tick: int) -> int:
        return math.ceil(tick * self.rule.tick_s * 1000)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            self.waiting.appendList(list(batch[["s", "id", "key", "ok"]].itertuples(index=False, name=None)))
            for tick in {self.rule.tick(s) for s in batch["s"]}:
                self.handle.registerTimer(max(self._at(tick + 1), timerValues.getCurrentWatermarkInMs() + 1))
        yield _frame([], ["queue", "id", "outcome", "tick"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = self.rule.tick(expiredTimerInfo.getExpiryTimeInMs() / 1000)
        rows, held, out = list(self.waiting.get()), dict(self.held.get()), []
        last = self.last.get()[0] if self.last.exists() else None
        for s, id_, name, ok in sorted((r for r in rows if self.rule.tick(r[0]) < now), key=lambda r: (r[0], r[1])):
            tick = self.rule.tick(s)
            held, gone = self.rule.drain(held, tick if last is None else last, tick)
            held, new = self.rule.step(held, tick, name, id_, ok)
            last, out = tick, out + gone + new
        if last is not None:
            held, gone = self.rule.drain(held, last, now)
            last, out = max(last, now), out + gone
            self.last.update((last,))
        _put(self.waiting, [r for r in rows if self.rule.tick(r[0]) >= now])
        _put(self.held, list(held.items()))
        if held:
            self.handle.registerTimer(self._at(now + 1))
        yield _frame([(key[0], *r) for r in out], ["queue", "id", "outcome", "tick"])

    def close(self) -> None:
        pass


def queued_stream(items: DataFrame, rule: QueueRule = QueueRule(), *, valid: Column | None = None, watermark: str = "0 seconds") -> DataFrame:
    """``queued`` of a stream: the queue is kept in the state store between micro-batches, at most ``rule.capacity`` keys."""
    ok = F.lit(True) if valid is None else F.coalesce(valid, F.lit(False))
    e = items.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark).select(F.col("queue").cast("string").alias("queue"), "ts", "id", "key", _seconds("ts").alias("s"), ok.alias("ok"))
    return e.where("queue IS NOT NULL").groupBy("queue").transformWithStateInPandas(_Queue(rule), f"queue string, {QUEUE}", "Append", "EventTime")


def write_outcomes(outcomes: DataFrame, path: str, checkpoint: str, *, trigger: dict[str, object] | None = None):
    """Writes flushed items into ``path`` and all others into a table of their own beside it, by micro-batch; one run again replaces its rows."""

    def write(batch: DataFrame, number: int) -> None:
        kept = batch.persist()  # read twice
        kept.where("outcome = 'flushed'").write.mode("overwrite").parquet(f"{path}/batch={number}")
        kept.where("outcome <> 'flushed'").write.mode("overwrite").parquet(f"{path}-others/batch={number}")
        kept.unpersist()

    return outcomes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

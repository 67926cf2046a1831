"""Streaming operators over file events, each with a batch twin that gives the same rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusloom.functions.text import temporary_file
from corpusloom.operators.folds import fold_in_order
from corpusloom.operators.ordered import within_after

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def as_events(df: DataFrame) -> DataFrame:
    """Watermarks need timestamps with a zone."""
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def event_stream(spark, folder: str, per_trigger: int = 1) -> DataFrame:
    """A stream of Parquet files of events; back-pressure by files a trigger."""
    return spark.readStream.schema(SCHEMA.replace("ts timestamp", "ts timestamp_ntz")).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def wanted(events: DataFrame) -> DataFrame:
    """Without errors and empty values: what a watcher ignores (temporary files, its own writes)."""
    return events.where("event_type <> 'error' AND value IS NOT NULL")


def watched(events: DataFrame, *, extensions: tuple[str, ...] | None = None, path: str = "path") -> DataFrame:
    """Events of files that a watcher looks at: no temporary or system files, and only these extensions (without dots) if given."""
    rows = events.where(~F.coalesce(temporary_file(F.col(path)), F.lit(True)))
    return rows if extensions is None else rows.where(F.lower(F.regexp_extract(path, r"[^/\\\\]\.([^./\\\\]+)$", 1)).isin(*extensions))


def not_our_own(events: DataFrame, operations: DataFrame, cooldown_s: float = 5.0) -> DataFrame:
    """Events (path, s, ...) but for those within ``cooldown_s`` after an operation (path, s) of ours on the same path."""
    return within_after(events, operations, "path", "s", cooldown_s, "_ours").where("NOT _ours").drop("_ours")


def debounced(events: DataFrame, gap: str = "1 hour", watermark: str | None = None) -> DataFrame:
    """(user_id, start, end, n, last_id): a trailing debounce; a session ends after a gap without events."""
    e = as_events(events)
    if watermark:
        e = e.withWatermark("ts", watermark)
    s = e.groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"), F.max_by("event_id", F.struct("ts", "event_id")).alias("last_id"))
    return s.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n", "last_id")


def windowed(events: DataFrame, size: str = "1 hour", slide: str | None = None, watermark: str | None = None) -> DataFrame:
    """(start, event_type, n, total) in tumbling or sliding windows."""
    e = as_events(events)
    if watermark:
        e = e.withWatermark("ts", watermark)
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return e.groupBy(w, "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def flushed(events: DataFrame, gap_s: float = 1.0, most_s: float = 5.0) -> DataFrame:
    """(user_id, start, flushed, n, last_id): a trailing debounce with a longest wait.

    A key's events are held until ``gap_s`` pass without another one, or ``most_s`` since the
    first; a busy key is flushed all the same. Times are seconds.
    """

    def step(state, s, event_id):
        if state is not None and s < (due := min(state[1] + gap_s, state[0] + most_s)):
            return (state[0], s, state[2] + 1, event_id), []
        return (s, s, 1, event_id), [] if state is None else [(state[0], due, state[2], state[3])]

    e = as_events(events).select("user_id", "event_id", (F.unix_micros("ts") / 1e6).alias("s"))
    last = lambda t: [] if t is None else [(t[0], min(t[1] + gap_s, t[0] + most_s), t[2], t[3])]
    return fold_in_order(e, "user_id", ["s", "event_id"], ["s", "event_id"], "user_id long, start double, flushed double, n long, last_id long", start=lambda: None, step=step, finish=last)


def flushed_stream(events: DataFrame, gap_s: float = 1.0, most_s: float = 5.0, watermark: str = "10 seconds") -> DataFrame:
    """The same as a stream: the held events of a key are four numbers in the state store, flushed by an event-time timer."""

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, out = (state.get if state.exists else None), []
        due = lambda t: min(t[1] + gap_s, t[0] + most_s)
        if state.hasTimedOut:
            out.append((key[0], held[0], due(held), held[2], held[3]))
            state.remove()
        else:
            rows = pd.concat([b[["s", "event_id"]] for b in batches]).sort_values(["s", "event_id"])
            for s, event_id in rows.itertuples(index=False, name=None):
                if held is not None and s < due(held):
                    held = (held[0], s, held[2] + 1, event_id)
                else:
                    if held is not None:
                        out.append((key[0], held[0], due(held), held[2], held[3]))
                    held = (s, s, 1, event_id)
            state.update(held)
            state.setTimeoutTimestamp(max(int(due(held) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["user_id", "start", "flushed", "n", "last_id"])

    e = as_events(events).withWatermark("ts", watermark).select("user_id", "ts", "event_id", (F.unix_micros("ts") / 1e6).alias("s"))
    return e.groupBy("user_id").applyInPandasWithState(step, "user_id long, start double, flushed double, n long, last_id long", "first double, last double, n long, last_id long", "append", GroupStateTimeout.EventTimeTimeout)


def accepted_after_gap(events: DataFrame, gap_s: float) -> DataFrame:
    """Events at least ``gap_s`` after the key's last accepted one: an ordered fold with one number of state."""

    def step(last, s, event_id):
        return (s, [(event_id,)]) if last is None or s - last >= gap_s else (last, [])

    e = as_events(events).select("user_id", "event_id", (F.unix_micros("ts") / 1e6).alias("s"))
    return fold_in_order(e, "user_id", ["s", "event_id"], ["s", "event_id"], "user_id long, event_id long", start=lambda: None, step=step, finish=lambda _: [])


def move_candidates(deleted: DataFrame, added: DataFrame, *, tolerance: str = "2 seconds", watermark: str | None = None) -> DataFrame:
    """(deleted, added): deletes (id, size, ext, ts) with every add of the same size and extension within the tolerance.

    A delete without one comes out with a null when its time is up: as a stream the join's
    state is bounded by the watermark, and that is the delete's timeout.
    """
    d = deleted.select(F.col("id").alias("deleted"), F.col("size").alias("size1"), F.col("ext").alias("ext1"), F.col("ts").cast("timestamp").alias("ts1"))
    a = added.select(F.col("id").alias("added"), "size", "ext", F.col("ts").cast("timestamp").alias("ts2"))
    if watermark:
        d, a = d.withWatermark("ts1", watermark), a.withWatermark("ts2", watermark)
    near = F.expr(f"size1 = size AND ext1 = ext AND ts2 >= ts1 - INTERVAL {tolerance} AND ts2 <= ts1 + INTERVAL {tolerance}")
    return d.join(a, near, "left").select("deleted", "added", "ts1")


def retry_counts(events: DataFrame, limit: int = 3) -> DataFrame:
    """(user_id, failures, outcome): failures in a row at the end; a success ends the run."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    run = F.sum((F.col("event_type") != "error").cast("int")).over(w)
    e = as_events(events).withColumn("run", run)
    last = e.groupBy("user_id", "run").agg(F.count_if(F.col("event_type") == "error").alias("failures"))
    last = last.groupBy("user_id").agg(F.max_by("failures", "run").alias("failures"))
    return last.withColumn("outcome", F.when(F.col("failures") == 0, "ok").when(F.col("failures") <= limit, "retry").otherwise("notify"))


def stateful_retries(events: DataFrame, limit: int = 3) -> DataFrame:
    """The same as a stream: one counter a key in the state store."""

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (failures,) = state.get if state.exists else (0,)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for kind in rows["event_type"]:
            failures = failures + 1 if kind == "error" else 0
        state.update((failures,))
        yield pd.DataFrame({"user_id": [key[0]], "failures": [failures], "outcome": ["ok" if not failures else "retry" if failures <= limit else "notify"]})

    return as_events(events).groupBy("user_id").applyInPandasWithState(step, "user_id long, failures long, outcome string", "failures long", "update", GroupStateTimeout.NoTimeout)


def circuit_states(events: DataFrame, failures: int = 5, open_s: float = 30.0, successes: int = 2, idle_s: float = 60.0) -> DataFrame:
    """(user_id, state, opened): the breaker after all of a service's events, and how often it opened.

    A success zeroes the failures of a closed breaker, and so does ``idle_s`` without events.
    An open one refuses events for ``open_s``; then it is half open, where a failure opens it
    again and ``successes`` in a row close it.
    """

    def step(now, s, kind):
        state, bad, good, since, last, opened = now
        if state == "OPEN" and s - since >= open_s:
            state, good = "HALF_OPEN", 0
        if state == "OPEN":
            return (state, bad, good, since, last, opened), []
        if state == "CLOSED" and last is not None and s - last >= idle_s:
            bad = 0
        last = s
        if kind == "error":
            bad += 1
            if state == "HALF_OPEN" or bad >= failures:
                state, since, opened, bad = "OPEN", s, opened + 1, 0
        elif state == "HALF_OPEN":
            good += 1
            if good >= successes:
                state, bad = "CLOSED", 0
        else:
            bad = 0
        return (state, bad, good, since, last, opened), []

    e = as_events(events).select("user_id", "event_id", "event_type", (F.unix_micros("ts") / 1e6).alias("s"))
    return fold_in_order(e, "user_id", ["s", "event_id"], ["s", "event_type"], "user_id long, state string, opened long", start=lambda: ("CLOSED", 0, 0, 0.0, None, 0), step=step, finish=lambda n: [(n[0], n[5])])


def undo_log(actions: DataFrame, limit: int = 50) -> DataFrame:
    """(session, seq, done): actions left in each session's log after undos and redos, the last ``limit``.

    A new action cuts off what was undone. ``actions``: (session, seq, kind do/undo/redo).
    """

    def step(state, seq, kind):
        log, at = state
        if kind == "undo":
            return (log, max(at - 1, 0)), []
        if kind == "redo":
            return (log, min(at + 1, len(log))), []
        log = [*log[:at], seq][-limit:]
        return (log, len(log)), []

    return fold_in_order(actions, "session", ["seq"], ["seq", "kind"], "session long, seq long, done boolean", start=lambda: ([], 0), step=step, finish=lambda s: [(seq, k < s[1]) for k, seq in enumerate(s[0])])


def flush_queue(items: DataFrame, write, *, refuse=None, size: int = 50, capacity: int = 500, high: float = 0.75, full: float = 0.9) -> dict[str, object]:
    """One micro-batch of an embedding queue, for ``foreachBatch``: the newest row of each key, in batches of ``size``.

    ``write(rows)`` gets the kept rows with their batch number. Of more than ``capacity`` keys
    the latest are refused: ``refuse(rows)`` gets them, to be tried again or kept as failed.
    Returns counts and the pressure: ok, high or full. For a queue that lasts from batch to
    batch see ``streaming.stateful``.
    """
    w = Window.partitionBy("key").orderBy(F.desc("ts"), F.desc("id"))
    newest = items.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    # Rows are numbered by counts of time's parts, so no task orders more than one part.
    part = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000)
    counts = newest.groupBy(part.alias("_part")).agg(F.count("*").alias("_c"))
    before = counts.select("_part", (F.sum("_c").over(Window.orderBy("_part")) - F.col("_c")).alias("_before"))  # one row a second of the batch
    placed = newest.withColumn("_part", part).join(before, "_part").withColumn("place", F.col("_before") + F.row_number().over(Window.partitionBy("_part").orderBy("ts", "id")) - 1)
    placed = placed.drop("_part", "_before")
    write(placed.where(F.col("place") < capacity).withColumn("batch", F.floor(F.col("place") / size)).drop("place"))
    n = newest.count()
    if refuse is not None and n > capacity:
        refuse(placed.where(F.col("place") >= capacity).drop("place"))
    kept = min(n, capacity)
    return {"kept": kept, "refused": n - kept, "batches": -(-kept // size), "pressure": "full" if n > full * capacity else "high" if n > high * capacity else "ok"}


def upsert_batches(stream: DataFrame, path: str, key: str, checkpoint: str, *, valid: Column | None = None, trigger: dict[str, object] | None = None):
    """Writes the latest row of each key of every micro-batch into a Parquet table of its own batch folder.

    A batch that is run again replaces its folder. Rows that are not ``valid`` go to a folder
    beside it. ``trigger``: what is there (the default), or for instance ``{"processingTime": "2 seconds"}``.
    """

    def write(batch: DataFrame, number: int) -> None:
        good = batch if valid is None else batch.where(F.coalesce(valid, F.lit(False)))
        w = Window.partitionBy(key).orderBy(F.desc("ts"), F.desc("event_id"))
        good.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn").write.mode("overwrite").parquet(f"{path}/batch={number}")
        if valid is not None:
            batch.where(~F.coalesce(valid, F.lit(False))).write.mode("overwrite").parquet(f"{path}-refused/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def latest_of_batches(spark, path: str, key: str) -> DataFrame:
    """The batch folders as one table: of each key the row of its last batch."""
    rows = spark.read.parquet(path)
    w = Window.partitionBy(key).orderBy(F.desc("batch"), F.desc("ts"), F.desc("event_id"))
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "batch")

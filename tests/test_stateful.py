"""Stateful streams against their batch twins, and these against plain loops."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusloom.streaming import stateful as S


@pytest.fixture
def rocks(spark):
    name, value = S.ROCKSDB
    old = spark.conf.get(name)
    spark.conf.set(name, value)
    yield spark
    spark.conf.set(name, old)


def streamed(spark, rows, schema, tmp_path, cuts):
    """The rows as a stream of files, in micro-batches cut at these places, and two late ones that move time on."""
    edges = [0, *cuts, len(rows)]
    for n, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        if a < b:
            spark.createDataFrame(rows[a:b], schema).coalesce(1).write.parquet(str(tmp_path / f"in/p{n:03d}"))
    return spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/p*")


def collected(df, spark, tmp_path):
    q = df.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    return spark.read.schema(df.schema).parquet(str(tmp_path / "out"))


def at(s):
    return f"2024-01-01 00:{int(s) // 60:02d}:{s % 60:09.6f}"


FILES = "id long, kind string, path string, size long, ts string, mtime double"
MOVED = [
    (1, "delete", "/a/one.txt", 10, 1.0, 100.0), (2, "add", "/b/uno.txt", 10, 2.0, 101.0),  # one candidate
    (3, "delete", "/a/x.txt", 20, 3.0, 100.0), (4, "delete", "/a/y.txt", 20, 3.5, 100.5), (5, "add", "/b/Y.txt", 20, 4.0, 100.0),  # tie, the name decides
    (6, "add", "/b/z.txt", 20, 4.2, 100.0),  # then x alone is left
    (7, "delete", "/a/p.txt", 30, 5.0, 100.0), (8, "delete", "/a/q.txt", 30, 5.0, 100.0), (9, "add", "/b/r.txt", 30, 6.0, 100.0),  # ambiguous
    (10, "delete", "/a/late.txt", 40, 7.0, 100.0), (11, "add", "/b/late.txt", 40, 13.0, 100.0),  # too late
    (12, "delete", "/a/t.txt", 50, 8.0, 100.0), (13, "add", "/b/t.txt", 50, 8.1, 103.0), (14, "add", "/b/t.pdf", 50, 8.2, 100.0),  # out of tolerance, another extension
    (15, "delete", "/a/same.txt", 60, 9.0, 100.0), (16, "add", "/a/same.txt", 60, 9.5, 100.0),  # the same path is no move
    (17, "delete", "/a/same.txt", 60, 9.7, 100.0),
    *((20 + n, "delete", f"/c/{n}.txt", 70, 10.0 + n / 10, 100.0 + 5 * n) for n in range(6)), (30, "add", "/d/new.txt", 70, 11.0, 100.0),  # the first of six is evicted
    (31, "add", "/d/3.txt", 70, 11.5, 115.0),
]
RULE = S.MoveRule(window_s=5.0, most=4)
BECAME = {
    (1, 2, "moved"), (4, 5, "moved"), (3, 6, "moved"), (7, None, "gone"), (8, None, "gone"), (10, None, "gone"), (12, None, "gone"),
    (15, None, "replaced"), (17, None, "gone"), (20, None, "evicted"), (21, None, "evicted"), (23, 31, "moved"), (22, None, "gone"), (24, None, "gone"), (25, None, "gone"),
}


def moves(df):
    rows = df.collect()
    assert len(rows) == len({r["deleted"] for r in rows})
    return {(r["deleted"], r["added"], r["outcome"], round(r["s"], 3)) for r in rows}


def stamped(rows):
    return [(*r[:4], at(r[4]), r[5]) for r in rows]


def test_moves_of_a_table(spark):
    got = moves(S.correlated_moves(spark.createDataFrame(stamped(MOVED), FILES).repartition(4), RULE))
    assert {g[:3] for g in got} == BECAME


def test_moves_of_a_stream(rocks, tmp_path):
    late = [(900, "add", "/z/none.bin", 1, 100.0, 0.0), (901, "add", "/z/none.bin", 1, 200.0, 0.0)]
    shuffled = MOVED[:12] + list(reversed(MOVED[12:18])) + MOVED[18:]  # within the watermark
    stream = streamed(rocks, stamped(shuffled + late), FILES, tmp_path, [3, 9, 20, len(MOVED), len(MOVED) + 1])
    got = moves(collected(S.correlated_moves_stream(stream, RULE, watermark="10 seconds"), rocks, tmp_path))
    assert got == moves(S.correlated_moves(rocks.createDataFrame(stamped(MOVED), FILES), RULE))


ITEMS = "queue string, key string, id long, ts string"


def some_items(n, seed=4):
    rng = random.Random(seed)
    s, out = 0.0, []
    for k in range(n):
        s = round(s + rng.choice([0.0, 0.1, 0.3, 2.5]), 1)
        out.append((rng.choice("ab"), rng.choice(["k1", "k2", "k3", "k4", "k5", "k6", "k7", None]), k, s))
    return out


def plain_queue(items, rule):
    """Tick by tick, as a clock would."""
    out = []
    for q in {i[0] for i in items}:
        own, held, tick = sorted((s, i, k) for x, k, i, s in items if x == q), [], None
        while own or held:
            tick = math.floor(own[0][0] / rule.tick_s) if tick is None else tick + 1
            for _, i in held[: rule.size]:
                out.append((q, i, "flushed", tick))
            held = held[rule.size :]
            while own and math.floor(own[0][0] / rule.tick_s) == tick:
                _, i, k = own.pop(0)
                place = [n for n, h in enumerate(held) if h[0] == k]
                if k is None or i % 10 == 9:
                    out.append((q, i, "failed", tick))
                elif place:
                    out.append((q, held[place[0]][1], "replaced", tick))
                    held[place[0]] = (k, i)
                elif len(held) < rule.capacity:
                    held.append((k, i))
                elif rule.overflow == "newest":
                    out.append((q, i, "refused", tick))
                else:
                    out.append((q, held.pop(0)[1], "dropped", tick))
                    held.append((k, i))
    return sorted(out)


@pytest.mark.parametrize("overflow", ["oldest", "newest"])
def test_queue_of_a_table(spark, overflow):
    rule, items = S.QueueRule(2, 1.0, 3, overflow), some_items(150)
    df = spark.createDataFrame([(q, k, i, at(s)) for q, k, i, s in items], ITEMS).repartition(3)
    base = spark.sql("SELECT unix_micros(CAST('2024-01-01' AS TIMESTAMP)) / 1e6 AS s").first()["s"]
    got = sorted((r["queue"], r["id"], r["outcome"], r["tick"] - int(base)) for r in S.queued(df, rule, valid=F.col("id") % 10 != 9).collect())
    assert got == plain_queue(items, rule)
    assert Counter(r[1] for r in got) == Counter(range(150))  # every item comes out once
    assert {r[2] for r in got} == {"flushed", "replaced", "failed", "dropped" if overflow == "oldest" else "refused"}


def test_queue_of_a_stream_and_its_tables(rocks, tmp_path):
    rule, items = S.QueueRule(2, 1.0, 3), some_items(90)
    rows = [(q, k, i, at(s)) for q, k, i, s in items]
    stream = streamed(rocks, [*rows, ("z", "late", 900, at(1_000.0)), ("z", "late", 901, at(2_000.0))], ITEMS, tmp_path, [7, 30, 31, 60, 90, 91])
    q = S.write_outcomes(S.queued_stream(stream, rule, valid=F.col("id") % 10 != 9), str(tmp_path / "t"), str(tmp_path / "tc"))
    assert q.awaitTermination(240)
    got = rocks.read.parquet(str(tmp_path / "t")).unionByName(rocks.read.parquet(str(tmp_path / "t-others"))).where("queue <> 'z'")
    want = S.queued(rocks.createDataFrame(rows, ITEMS), rule, valid=F.col("id") % 10 != 9)
    four = lambda df: sorted((r["queue"], r["id"], r["outcome"], r["tick"]) for r in df.collect())
    assert four(got) == four(want)
    assert rocks.read.parquet(str(tmp_path / "t")).where("outcome <> 'flushed'").isEmpty()

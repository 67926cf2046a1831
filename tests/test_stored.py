"""Versions that survive failing writers, the stored index and stored aggregates."""

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import index as stored_index
from corpusloom.operators.aggregates import StoredAggregate
from corpusloom.operators.index import StoredIndex
from corpusloom.operators.search import bm25
from corpusloom.sources.readers import save
from corpusloom.sources.snapshots import Conflict, SnapshotStore, commit_on_flush
from corpusloom.streaming.events import flushed_stream


def failing(spark):
    return spark.range(20).select(F.when(F.col("id") == 19, F.raise_error(F.lit("disk full"))).otherwise(F.col("id")).alias("id"))


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_a_failed_commit_leaves_the_old_rows(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "s"))
    assert store.latest() is None and store.read("t") is None
    store.commit({"t": spark.range(3)})
    with pytest.raises(Exception, match="disk full"):
        store.commit({"t": failing(spark), "u": spark.range(1)})
    assert ids(store.read("t")) == [0, 1, 2] and store.read("u") is None
    store.commit({"u": spark.range(2)}, add={"t": spark.range(5, 6)})
    assert ids(store.read("t")) == [0, 1, 2, 5] and ids(store.read("u")) == [0, 1]
    assert {r["segment"] for r in store.read("t").collect()} == {0, 1}


def test_save_keeps_the_old_rows_when_it_fails(spark, tmp_path):
    at = str(tmp_path / "o")
    save(spark.range(4), at)
    with pytest.raises(Exception, match="disk full"):
        save(failing(spark), at)
    assert ids(spark.read.parquet(at)) == [0, 1, 2, 3]
    save(spark.range(2), at)
    assert ids(spark.read.parquet(at)) == [0, 1]
    assert os.listdir(tmp_path) == ["o"]


def test_torn_versions_fall_back_and_old_ones_go(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path))
    first = store.commit({"t": spark.range(1)})
    second = store.commit({"t": spark.range(2)})
    (tmp_path / "manifests/3.json").write_text('{"tables": {')
    assert store.latest().number == second.number
    store.commit({"t": spark.range(3)})
    assert store.latest().number == 4 and ids(store.read("t")) == [0, 1, 2]
    os.remove(glob.glob(f"{tmp_path}/{store.latest().tables['t'][0].path}/_SUCCESS")[0])
    assert store.latest().number == second.number
    back = store.restore(first.number)
    assert ids(store.read("t")) == [0] and back.tables == first.tables
    with pytest.raises(ValueError, match="no whole version"):
        store.restore(77)
    store.write(spark.range(9))  # of a commit that never came
    assert store.clean(keep=1, grace_s=3_600) == []
    assert len(store.clean(keep=1, grace_s=0)) == 3
    assert [v.number for v in store.versions()] == [back.number] and ids(store.read("t")) == [0]


def test_of_two_writers_one_commits(spark, tmp_path):
    a, b = SnapshotStore(spark, str(tmp_path)), SnapshotStore(spark, str(tmp_path))
    base = a.commit({"t": spark.range(1)})
    a.commit({"t": spark.range(2)}, base=base)
    with pytest.raises(Conflict):
        b.commit({"t": spark.range(3)}, base=base)
    with pytest.raises(Conflict):
        b._put("{}", "manifests/2.json")
    assert ids(b.read("t")) == [0, 1]


def test_debounced_changes_save(spark, tmp_path):
    source, store = tmp_path / "in", SnapshotStore(spark, str(tmp_path / "store"))
    rows = [(n, f"2024-01-01 00:00:{s:02d}", 1) for n, s in enumerate((0, 1, 2, 20, 21, 59))]
    for n, part in enumerate((rows[:3], rows[3:5], rows[5:])):
        df = spark.createDataFrame(part, "event_id long, ts string, user_id long").withColumn("ts", F.col("ts").cast("timestamp"))
        df.coalesce(1).write.parquet(str(source / f"p{n}"))
    stream = spark.readStream.schema("event_id long, ts timestamp, user_id long").option("maxFilesPerTrigger", 1).parquet(f"{source}/p*")
    tables = lambda: {"t": spark.range(len(store.versions()) + 1)}
    flushes = flushed_stream(stream, 5.0, 30.0, "0 seconds")
    q = commit_on_flush(flushes, store, tables, str(tmp_path / "c"))
    assert q.awaitTermination(120)
    versions = store.versions()
    assert versions and sum(v.note["flushes"] for v in versions) == 2  # the last change still waits for five quiet seconds
    assert ids(store.read("t")) == list(range(len(versions)))


DOCS = [
    (1, "alpha beta beta", "red", 1), (2, "alpha", None, 1), (3, None, "red blue", 1), (4, "", "", 1), (5, "beta " * 900 + "rare", "blue", 1),
    (6, "alpha beta gamma", "green red", 1), (1, "old old words", "red", 0), (None, "alpha", "red", 5),
]
FIELDS = {"text": 2.0, "tag": 1.0}
SCHEMA = "doc_id long, text string, tag string, ts long"
ASKED = [(1, "alpha beta"), (2, "red"), (3, "nowhere"), (4, "rare gamma blue blue"), (5, ""), (6, None)]


def rows(df):
    return sorted((r["query"], r["rank"], r["id"], round(r["score"], 7)) for r in df.collect())


def newest(docs):
    out = {}
    for d in sorted((d for d in docs if d[0] is not None), key=lambda d: d[3]):
        out[d[0]] = d
    return out


@pytest.mark.parametrize("k", [2])
def test_index_equals_scoring_all_texts_through_deltas(spark, tmp_path, k):
    asked = spark.createDataFrame(ASKED, "query long, text string")
    index = StoredIndex(spark, str(tmp_path))
    assert not index.status().built
    with pytest.raises(ValueError, match="build it first"):
        index.search(asked)
    index.build(spark.createDataFrame(DOCS, SCHEMA), FIELDS, ts="ts", buckets=8)
    now = newest(DOCS)
    plain = lambda: rows(bm25(spark.createDataFrame(list(now.values()), SCHEMA), asked, FIELDS, k=k))
    assert rows(index.search(asked, k)) == plain()
    changed = [(2, "beta gamma", "blue", 7), (7, "alpha alpha rare", "red", 7), (7, "older", "red", 6), (5, "short beta", None, 7)]
    index.apply(spark.createDataFrame(changed, SCHEMA))
    now |= newest(changed)
    assert rows(index.search(asked, k)) == plain()
    index.apply(None, spark.createDataFrame([(1,), (99,), (None,)], "doc_id long"))
    now.pop(1)
    assert rows(index.search(asked, k)) == plain()
    index.apply(spark.createDataFrame([(1, "alpha again", "red", 9)], SCHEMA), spark.createDataFrame([(6,)], "doc_id long"))
    now.pop(6)
    now[1] = (1, "alpha again", "red", 9)
    assert rows(index.search(asked, k)) == plain()
    status = index.status(spark.createDataFrame([(1, "x", "y", 10)], SCHEMA))
    assert status.documents == len(now) and status.segments == 3 and status.stale and status.indexed_to == 9
    before = {tuple(r) for r in index.term_counts().collect()}
    index.compact()
    assert {tuple(r) for r in index.term_counts().collect()} == before
    assert rows(index.search(asked, k)) == plain()
    index.clear()
    assert not index.status().built


def test_search_reads_the_buckets_of_its_terms_and_skips_blocks(spark, tmp_path):
    rng = random.Random(4)
    words = [f"w{n}" for n in range(400)]
    docs = [(n, " ".join(rng.choices(words, k=30)) + (" needle" * 40 if n % 1_000 == 0 else ""), "x", n) for n in range(6_000)]
    index = StoredIndex(spark, str(tmp_path))
    index.build(spark.createDataFrame(docs, SCHEMA), {"text": 1.0}, buckets=16)
    asked = spark.createDataFrame([(1, "needle w7")], "query long, text string")
    report = {}
    want = rows(index.search(asked, 5, report=report))
    assert 0 < report["scored"] < report["blocks"]
    assert want == rows(bm25(spark.createDataFrame(docs, SCHEMA), asked, {"text": 1.0}, k=5))
    kept = set(index._buckets(spark.createDataFrame([("needle",), ("w7",)], "term string")))
    for at in glob.glob(f"{tmp_path}/data/*/bucket=*"):
        if int(at.rsplit("=", 1)[1]) not in kept:  # a search must not open them
            for f in glob.glob(f"{at}/*"):
                open(f, "w").write("damaged")
    spark.catalog.clearCache()
    assert rows(index.search(asked, 5)) == want


def test_a_search_shuffles_blocks_and_not_their_documents(spark, tmp_path, monkeypatch):
    asked = spark.createDataFrame(ASKED, "query long, text string")
    index = StoredIndex(spark, str(tmp_path))
    index.build(spark.createDataFrame(DOCS, SCHEMA), FIELDS, ts="ts", buckets=2)
    found = index.search(asked, 3)
    assert "Generate" not in found._jdf.queryExecution().toString()
    want = rows(found)
    assert want and want == rows(bm25(spark.createDataFrame(list(newest(DOCS).values()), SCHEMA), asked, FIELDS, k=3))
    monkeypatch.setattr(stored_index, "MAX_KNOWN", 4)  # queries are searched in parts
    assert rows(index.search(asked, 3)) == want


def aggregate(spark, at):
    return StoredAggregate(spark, str(at), {"tag": F.col("tags"), "kind": F.col("kind"), "ts": F.col("ts")}, {"size": F.col("size")}, most_segments=3)


HISTORY = "id long, kind string, tags array<string>, ts long, size long"


def test_aggregate_follows_random_changes(spark, tmp_path):
    rng, kept, live = random.Random(2), aggregate(spark, tmp_path), {}
    with pytest.raises(ValueError, match="rebuild first"):
        kept.values()
    for step in range(6):
        new = [(step * 10 + n, rng.choice(["a", "b", None]), rng.choice([["x", "y", "x"], ["z"], [], None]), rng.randrange(100), rng.choice([1, 5, None])) for n in range(6)]
        gone = rng.sample(sorted(live), len(live) // 2)
        away = [live.pop(i) for i in gone]
        frame = lambda x: spark.createDataFrame(x, HISTORY)
        for _ in range(2):  # a batch that is run again changes nothing
            kept.apply(frame(new), frame(away), batch=step)
        live |= {r[0]: r for r in new}
        values = {(r["dimension"], r["value"]): (r["n"], r["size"]) for r in kept.values().where("dimension <> ''").collect()}
        want = {}
        for _, kind, tags, ts, size in live.values():
            for key in {*(("tag", t) for t in tags or []), *([("kind", kind)] if kind else []), ("ts", str(ts))}:
                n, s = want.get(key, (0, 0))
                want[key] = (n + 1, s + (size or 0))
        assert values == want
        t = kept.totals(distinct=("tag", "kind"), span={"ts": "long"}).first()
        stamps = [r[3] for r in live.values()]
        assert (t["n"], t["size"]) == (len(live), sum(r[4] or 0 for r in live.values()))
        assert (t["tag_values"], t["kind_values"]) == (len({k for k in want if k[0] == "tag"}), len({k for k in want if k[0] == "kind"}))
        assert (t["first_ts"], t["last_ts"]) == (min(stamps), max(stamps))
    assert len(kept.store.latest().tables["sums"]) <= 3
    kept.apply(None, spark.createDataFrame(list(live.values()), HISTORY))
    assert kept.values("tag").count() == 0 and kept.totals().first()["n"] == 0


def test_aggregate_from_a_stream(spark, tmp_path):
    kept = aggregate(spark, tmp_path / "a")
    for n, part in enumerate(([(1, "a", ["x"], 5, 2, 1), (2, "b", ["x"], 6, 3, 1)], [(1, "a", ["x"], 5, 2, -1), (3, "a", ["y"], 9, 4, 1)])):
        spark.createDataFrame(part, HISTORY + ", sign int").coalesce(1).write.parquet(str(tmp_path / f"in/p{n}"))
    stream = spark.readStream.schema(HISTORY + ", sign int").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/p*")
    q = stream.writeStream.foreachBatch(kept.apply_batch).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert {(r["value"], r["n"]) for r in kept.values("tag").collect()} == {("x", 1), ("y", 1)}
    assert kept.totals().first()["size"] == 7

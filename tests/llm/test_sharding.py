import random
import zlib
from collections import defaultdict

from corpusloom.llm import sharding
from corpusloom.llm.sharding import CapacityTree, best_fit_decreasing, shard_documents, smallest_capacity


def brute_best_fit(sizes, capacity):
    left, out = [], []
    for s in sizes:
        fits = [(r, k) for k, r in enumerate(left) if r >= s]
        if fits:
            k = min(fits)[1]
        else:
            k = len(left)
            left.append(capacity)
        left[k] -= s
        out.append(k)
    return out


def test_tree_stays_balanced_and_sorted():
    rng, tree, plain = random.Random(4), CapacityTree(), []
    for k in range(3_000):
        if plain and rng.random() < 0.4:
            size = rng.randrange(1_000)
            got = tree.tightest(size)
            want = min((x for x in plain if x[0] >= size), default=None)
            assert got == want
            if want:
                plain.remove(want)
        else:
            x = (rng.randrange(1_000), k)
            plain.append(x)
            tree.add(*x)

    def depth(node):
        return 1 + max(depth(node[0]), depth(node[2])) if node else 0

    assert depth(tree.root) <= 25


def test_best_fit_against_brute_force():
    rng = random.Random(5)
    for _ in range(30):
        sizes = sorted((rng.randint(1, 100) for _ in range(80)), reverse=True)
        assert best_fit_decreasing(sizes, 120) == brute_best_fit(sizes, 120)
    assert max(smallest_capacity(sizes, 7)) < 7 and smallest_capacity([], 3) == []


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    extra = [(None, None), (None, None), (90_001, ""), (90_002, "long " * 30_000), (90_003, "long " * 30_000), (90_003, "long " * 30_000)]
    mixed = docs.unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    rows = shard_documents(mixed, 24).collect()
    texts = {r["doc_id"]: r["text"] for r in mixed.collect()}
    assert len(rows) == docs.count() + 6
    slots, size, shards = defaultdict(list), defaultdict(int), defaultdict(set)
    for r in rows:
        text = texts[r["doc_id"]] or ""
        assert r["size"] == len(text.encode()) + 8 and r["text_crc32"] == zlib.crc32(text.encode())
        slots[r["shard"]].append(r["slot"])
        size[r["shard"]] += r["size"]
        shards[text].add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and {*slots} == set(range(24))
    assert all(len(s) == 1 for s in shards.values())
    alone = size.pop(next(iter(shards["long " * 30_000])))
    assert alone >= 450_000 and max(size.values()) - min(size.values()) < 0.01 * sum(size.values()) / 23
    assert shard_documents(mixed.limit(0), 24).count() == 0
    few = shard_documents(mixed.limit(3), 24).collect()
    assert len(few) == 3


def test_one_row_repeated_for_a_third_of_the_table(spark):
    rows = [(n, f"text {n}", 1, "x") for n in range(4_000)] + [(7, "again", 2, "y")] * 2_000
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int, size string").repartition(12)
    got = shard_documents(docs.withColumnRenamed("size", "slot"), 6)
    assert got.columns == ["doc_id", "size", "text_crc32", "shard", "slot"]
    by_shard = defaultdict(list)
    for r in got.collect():
        by_shard[r["shard"]].append(r["slot"])
    assert sum(map(len, by_shard.values())) == 6_000
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())


def test_many_buckets_reach_the_driver_as_a_bounded_number(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_GROUPS", 10)
    docs = spark.range(3_000).selectExpr("id AS doc_id", "repeat(cast(id AS string), cast(1 + id % 40 AS int)) AS text")
    sizes = []
    for most in (65_536, 7):
        monkeypatch.setattr(sharding, "MAX_BUCKETS", most)
        rows = shard_documents(docs, 5).collect()
        size = defaultdict(int)
        for r in rows:
            size[r["shard"]] += r["size"]
        assert len(rows) == 3_000 and len(size) == 5
        sizes.append(max(size.values()) - min(size.values()))
        assert sizes[-1] < 0.02 * sum(size.values()) / 5

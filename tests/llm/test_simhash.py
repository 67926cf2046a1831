import numpy as np
import pandas as pd
import xxhash

from corpusloom.llm import simhash
from corpusloom.llm.simhash import components, fingerprint, keep_one_of_each, links, near_groups


def brute_fingerprint(text):
    import re

    words = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_roots(fps):
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    arr = np.array(sorted(fps), dtype=np.uint64)
    for i in range(len(arr)):
        for j in np.flatnonzero(np.bitwise_count(arr[i + 1 :] ^ arr[i]) <= 3):
            a, b = root(int(arr[i])), root(int(arr[i + 1 + j]))
            parent[max(a, b)] = min(a, b)
    return {f: root(f) for f in fps}


def planted(seed=1):
    rng = np.random.default_rng(seed)
    out = set()
    for size in (2, 3, 40, 400):
        now = int(rng.integers(0, 1 << 63))
        for _ in range(size):
            out.add(now)
            for b in rng.choice(64, rng.integers(1, 6), replace=False):
                now ^= 1 << int(b)
    centre = int(rng.integers(0, 1 << 63))
    for _ in range(600):  # many within a few bits of one
        x = centre
        for b in rng.choice(64, rng.integers(0, 4), replace=False):
            x ^= 1 << int(b)
        out.add(x)
    return out | {0}


def partition(pairs):
    by = {}
    for node, root in pairs:
        by.setdefault(root, set()).add(node)
    return {frozenset(v) for v in by.values()}


def check(spark, fps):
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    got = components(links(df)).collect()
    roots = {r["node"] & (1 << 64) - 1: r["root"] for r in got}
    assert partition((f, roots.get(f, f)) for f in fps) == partition(brute_roots(fps).items())


def test_links_against_brute_force(spark):
    check(spark, planted())


def test_buckets_that_span_batches():
    rng = np.random.default_rng(7)
    centre = rng.integers(0, 1 << 62, 40).astype(np.uint64)
    rows = []
    for k, c in enumerate(centre):
        near = {int(c ^ np.uint64(1 << b)) for b in range(rng.integers(0, 6))} | {int(c)}
        rows += [(k % 4, k // 4, f) for f in sorted(near)]
    rows.sort()
    whole = pd.DataFrame(rows, columns=["shift", "key", "fp"])
    whole["fp"] = whole["fp"].to_numpy(dtype=np.uint64).view(np.int64)
    want = [tuple(r) for d in simhash._links(iter([whole])) for r in d.to_numpy()]
    for size in (1, 2, 7):
        parts = [whole.iloc[a : a + size] for a in range(0, len(whole), size)] + [whole.iloc[:0]]
        assert [tuple(r) for d in simhash._links(iter(parts)) for r in d.to_numpy()] == want
    assert len(want) > 40


def test_divided_buckets_lose_no_link(monkeypatch):
    fps = planted(2)
    arr = np.array(sorted(fps), dtype=np.uint64)
    want = partition(brute_roots(fps).items())
    monkeypatch.setattr(simhash, "MAX_BUCKET", 16)
    pairs = simhash._divided(arr, (1 << 64) - 1, 0)
    # Divided buckets keep the chain filter of their own rotation, so all four rotations together have every link.
    for shift in (1, 2, 3):
        pairs += simhash._divided(arr, (1 << 64) - 1, shift)
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        assert (a ^ b).bit_count() <= 3
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    assert partition((f, root(f)) for f in fps) == want


def test_fingerprints():
    for text in (None, "", " \n", "one", "One two", "a b c", "A b C d e", "é  b\tc\x0bd", "x y z " * 30_000):
        assert fingerprint(text) == brute_fingerprint(text)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    edges = [(9001, None, "x"), (9000, "", None), (None, "", "y"), (9002, "  ", "x"), (9001, None, "x")]
    mixed = docs.selectExpr("doc_id", "text", "'s' AS _sha").unionByName(spark.createDataFrame(edges, "doc_id long, text string, _sha string"))
    rows = near_groups(mixed).collect()
    assert len(rows) == docs.count() + 5
    assert {r["component_id"] for r in rows if r["fingerprint"] == "0" * 16} == {9000}
    for r in docs.limit(50).collect():
        assert f"{brute_fingerprint(r['text']):016x}" in {x["fingerprint"] for x in rows if x["doc_id"] == r["doc_id"]}
    kept = keep_one_of_each(mixed).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted({r["component_id"] for r in rows})
    assert kept[0].__fields__ == ["doc_id", "text", "_sha"]
    assert near_groups(mixed.limit(0)).count() == 0 and keep_one_of_each(mixed.limit(0)).count() == 0

import hashlib
import random
from collections import defaultdict

import numpy as np

from corpusloom.llm import exact_dedup as X


def test_chunks_cover_and_survive_shifts():
    rng = random.Random(1)
    data = bytes(rng.randrange(97, 123) for _ in range(200_000))
    ends = X.cut_points(data)
    assert ends[-1] == len(data) and ends == sorted(set(ends))
    sizes = [b - a for a, b in zip([0, *ends], ends, strict=False)]
    assert max(sizes) <= X.MAX_CHUNK and min(sizes[:-1]) >= X.MIN_CHUNK
    text = data.decode()
    same = {*X.chunks_of(text)} & {*X.chunks_of("zz" + text)}
    assert len(same) > 0.8 * len(ends)
    assert X.chunks_of(None) == X.chunks_of("") == []


def brute(rows):
    by = defaultdict(list)
    for doc_id, text in rows:
        by[text or ""].append(doc_id)
    out = []
    for text, ids in by.items():
        keep = max((i for i in ids if i is not None), default=None)
        left = 1
        for i in ids:
            kept = i == keep and left > 0
            left -= kept
            out.append((i, keep, len(ids), kept, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def test_groups_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    extra = [(9001, None), (9002, ""), (None, ""), (9003, "x" * 60_000), (9004, "x" * 60_000), (9004, "x" * 60_000), (None, "only null ids"), (None, "only null ids"), (9005, "é" * 9_000)]
    mixed = docs.unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    got = sorted((tuple(r) for r in X.exact_groups(mixed).collect()), key=str)
    assert got == brute([tuple(r) for r in mixed.collect()])
    kept = X.drop_exact_copies(mixed.selectExpr("doc_id", "text", "1 AS _sha", "2 AS _key"))
    assert kept.columns == ["doc_id", "text", "_sha", "_key"]
    assert sorted((r["text"] or "" for r in kept.collect())) == sorted({r["text"] or "" for r in mixed.collect()})
    assert X.exact_groups(mixed.limit(0)).count() == 0 and X.drop_exact_copies(mixed.limit(0)).count() == 0


def test_only_texts_with_repeated_chunks_are_verified(spark):
    rng = random.Random(2)
    noise = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    shared = noise(30_000)
    rows = [(k, noise(5_000)) for k in range(50)] + [(100, shared), (101, "x" + shared), (102, "short"), (103, "short"), (104, None), (105, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    cut = X.recipes(docs)
    want = {hashlib.sha256(t.encode()).hexdigest() for i, t in rows if i in (100, 101, 102)}
    assert {r["text_sha256"] for r in X.texts_with_repeated_chunks(cut).collect()} == want
    filter_ = X.bloom(X.texts_with_repeated_chunks(cut))
    through = [i for i, t in rows if t and X.may_hold(filter_, hashlib.sha256(t.encode()).digest())]
    assert {100, 101, 102, 103} <= {*through} and len(through) < 10
    assert all(X.may_hold(X.bloom(X.texts_with_repeated_chunks(cut), 64), bytes.fromhex(w)) for w in want)  # a full filter misses none
    assert X.collided_identifiers(docs, filter_).count() == 0


def test_collisions_are_told_apart(spark):
    """With identifiers that know a chunk's length alone, texts of equal length collide and are told apart all the same."""

    def by_length(chunk):
        return bytes(24) + len(chunk).to_bytes(8, "little")

    rows = [(1, "one"), (2, "two"), (3, "two"), (4, "three"), (5, "x" * 40_000), (6, "y" * 40_000), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    everything = np.full(1, 2**64 - 1, dtype=np.uint64)
    assert {int.from_bytes(bytes(r["id"])[24:], "little") for r in X.collided_identifiers(docs, everything, identify=by_length).collect()} >= {3}
    got = sorted((tuple(r) for r in X.exact_groups(docs, identify=by_length).collect()), key=str)
    assert got == brute(rows)

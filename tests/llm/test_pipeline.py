import hashlib
import re

import public_tokenizers
import sentencepiece
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from corpusloom.llm.queries import QUERIES
from corpusloom.llm.toxicity import fit_toxicity, score_toxicity
from corpusloom.session import is_train, table

SF = "/root/testdata/sf0.001"


def test_every_operator_is_registered():
    assert [int(n.split("_")[0][2:]) for n in QUERIES] == list(range(1, 14))


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def fingerprint(text):
    w = re.findall("[^\x20\x09-\x0d]+", lower(text))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def near(rows):
    """Of each component of fingerprints within three bits the row with the smallest id, nulls last."""
    prints = [fingerprint(r["text"]) for r in rows]
    group = list(range(len(rows)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                group[root(a)] = root(b)
    best = {}
    for k, r in enumerate(rows):
        key = (r["doc_id"] is None, r["doc_id"] or 0)
        best[root(k)] = min(best.get(root(k), (key, k)), (key, k), key=lambda x: x[0])
    return [rows[k] for _, k in best.values()]


def exact(rows):
    """Of equal texts the row with the largest id, one of repeated ones."""
    best = {}
    for r in rows:
        old = best.get(r["text"] or "")
        if old is None or (r["doc_id"] is not None and (old["doc_id"] is None or r["doc_id"] > old["doc_id"])):
            best[r["text"] or ""] = r
    return list(best.values())


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(text))


def clean(rows, items):
    wins = {tuple(w[i : i + 10]) for t in items if (w := words(t)) for i in range(max(len(w) - 9, 1))}
    sizes = {len(w) for w in wins}
    return [r for r in rows if not any(tuple(w[i : i + n]) in wins for w in (words(r["text"]),) for n in sizes for i in range(len(w) - n + 1))]


def by_id(rows):
    return sorted(((r["doc_id"], r["text"]) for r in rows), key=str)


def test_stages_against_brute_force(spark, monkeypatch):
    docs = table(spark, SF, "documents")
    some = docs.where("text IS NOT NULL").first()["text"]
    item = table(spark, SF, "benchmark").first()["text"]
    odd = [(900_001, None, None, None, None), (900_002, "", "en", "x", 0), (None, some, None, None, None), (900_003, some, "en", "x", 1), (900_003, some, "en", "x", 1), (900_004, f"well {item} then", "en", "x", 9), (900_005, "word " * 30_000, "en", "x", 9)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    rows = docs.collect()

    labels = table(spark, SF, "labels").select("doc_id", "toxic").where(is_train("doc_id", 5))
    scored = score_toxicity(docs, fit_toxicity(docs, labels))  # tested against brute force where it is made
    want = scored.where(F.col("score") < 0.5).collect()
    left = {}
    stages = dict(corpus_pipeline.STAGES)
    for name, brute in (("toxicity", lambda _: want), ("exact_dedup", exact), ("near_dedup", near), ("decontamination", lambda rs: clean(rs, [r["text"] for r in table(spark, SF, "benchmark").collect()]))):
        out = stages[name](spark, docs, SF).cache()
        assert out.columns == docs.columns
        got = out.collect()
        assert by_id(got) == by_id(brute(rows)), name
        docs, rows, left[name] = out, got, len(got)
    assert list(left.values()) == sorted(left.values(), reverse=True)
    codec = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r["doc_id"]: r["text"] or "" for r in rows}
    for r in stages["encoding"](spark, docs, SF).collect():
        ids = codec.encode(texts[r["doc_id"]], add_bos=True, add_eos=True)
        assert list(r["ids"]) == ids and r["n_tokens"] == len(ids)
        assert r["decoded_sha256"] == hashlib.sha256(codec.decode(ids).encode()).hexdigest()

    # The whole run, by the table in place of the one that is read.
    real = corpus_pipeline.table
    monkeypatch.setattr(corpus_pipeline, "table", lambda s, d, n: spark.createDataFrame(odd, real(s, d, n).schema) if n == "documents" else real(s, d, n))
    assert len(corpus_pipeline.run(spark, SF).collect()) == 3  # of seven: two kinds of text, an empty one, and the long one less the leaked one
    monkeypatch.setattr(corpus_pipeline, "table", lambda s, d, n: real(s, d, n).limit(0))
    assert corpus_pipeline.run(spark, SF).count() == 0


def test_run_is_the_stages_in_turn(spark):
    docs = table(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    key = lambda df: sorted((r["doc_id"], r["ids_sha256"]) for r in df.collect())
    assert key(corpus_pipeline.run(spark, SF)) == key(docs)

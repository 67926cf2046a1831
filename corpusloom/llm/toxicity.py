"""Toxicity: a learned weighted lexicon, matched by Aho-Corasick on folded text.

Folding maps look-alike letters of other scripts, full-width forms and digits used as
letters onto one skeleton, so that an obfuscated spelling meets the lexicon entry. Entries
are whole words and, written with a star, beginnings of longer words (``STEMS`` bytes), so
that one stem with many endings is one entry. The weights of the entries that a text has
outside exception phrases are added up, divided by a slowly growing function of its length,
and turned into a probability; weights and intercept are a logistic regression on the
labelled rows, so weak entries have small weights and count together.

Defined results: null and empty texts have no hits and get the score of a text without
hits; without labelled rows, or with one class only, the lexicon is empty and the score
is the labelled share (0 without labels) held under 0.5. Repeated rows are scored one by
one, but equal labelled texts are learned from once. Labels with a null are not used, and of
contradicting labels of one id or text the toxic one counts. Other columns of the input are
carried along, but for those of the output's names, which are replaced.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import accumulate

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.scan import WORD_BYTES, bounded_batches, line_of, places
from corpusloom.session import cut_lineage, fresh_name

#: Letters of other scripts that look like Latin ones.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j",
    "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "ԁ": "d", "ո": "n", "ս": "u", "ɡ": "g", "ɑ": "a",
    "α": "a", "ο": "o", "ρ": "p", "ν": "v", "κ": "k", "ι": "i", "τ": "t", "υ": "u", "χ": "x", "ε": "e",
    "ı": "i", "ʟ": "l", "ӏ": "l", "ѵ": "v", "ԝ": "w",
}
#: Digits and signs written for letters; i, l and 1 share one skeleton.
SUBSTITUTIONS = {"0": "o", "1": "l", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "i": "l"}
STEMS = (5, 7)
#: Phrases in which an entry means no offence.
EXCEPTIONS = ("trash can", "trash bag", "trash bin", "class clown", "clown fish", "not stupid", "loser bracket")

_FOLD = {ord(k): v for k, v in HOMOGLYPHS.items()} | {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
_FOLD |= {c: None for c in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)}
_FOREIGN = re.compile("[" + "".join(re.escape(chr(c)) for c in sorted(_FOLD)) + "]")
_SKELETON = bytearray(WORD_BYTES)
for _a, _b in SUBSTITUTIONS.items():
    _SKELETON[ord(_a)] = ord(_b)
_SKELETON[ord("I")] = ord("l")
_SKELETON = bytes(_SKELETON)


def folded_words(text: str | None) -> list[bytes]:
    """Lower-cased words after folding; none for null."""
    text = (text or "").lower()
    if _FOREIGN.search(text):
        text = text.translate(_FOLD).lower()
    return text.encode().translate(_SKELETON).split()


def entries_of(words: list[bytes]) -> set[bytes]:
    """What a text can be matched by: its words, and the beginnings of longer ones with a star."""
    whole = {*words}
    return whole.union(*({w[:n] + b"*" for w in whole if len(w) > n} for n in STEMS))


@dataclass(frozen=True)
class ToxicityModel:
    """What scoring needs: weights of words and of stems (with a star)."""

    weights: tuple[tuple[bytes, float], ...] = ()
    exceptions: tuple[str, ...] = EXCEPTIONS
    intercept: float = 0.0
    report: dict = field(default_factory=dict, hash=False, compare=False)


@lru_cache(maxsize=4)
def _automaton(entries: tuple[bytes, ...], exceptions: tuple[str, ...]) -> ahocorasick.Automaton:
    """Finds entries by their number, and exception phrases as -1."""
    found = ahocorasick.Automaton()
    for phrase in exceptions:
        key = line_of(folded_words(phrase))
        found.add_word(key, (len(key), -1))
    for k, entry in enumerate(entries):
        key = line_of([entry])
        key = key[:-2] if entry.endswith(b"*") else key
        found.add_word(key, (len(key), k))
    if len(found):
        found.make_automaton()
    return found


def text_hits(found: ahocorasick.Automaton, text: str | None) -> tuple[list[int], int, float]:
    """Distinct entries outside exception phrases, the number of their places, and what the sum is divided by."""
    words = folded_words(text)
    at = places(found, line_of(words))
    spared = sorted((a, b) for a, b, k in at if k < 0)
    if spared:  # of the phrases that begin no later, does the one that ends last reach the entry's end?
        starts = [a for a, _ in spared]
        reach = list(accumulate((b for _, b in spared), max))
        at = [(a, b, k) for a, b, k in at if not ((n := bisect_right(starts, a)) and reach[n - 1] >= b)]
    hits = [k for _, _, k in at if k >= 0]
    return sorted({*hits}), len(hits), 1 + math.log1p(len(words))


def toxic_load(model: ToxicityModel, text: str | None) -> tuple[float, int]:
    """Weights of the distinct entries found over 1 + ln(1 + words), and the number of hits that count."""
    found, n, length = text_hits(_automaton(tuple(e for e, _ in model.weights), model.exceptions), text)
    return sum(model.weights[k][1] for k in found) / length, n


def labelled_sample(labels: DataFrame, id_col: str, label_col: str, max_rows: int) -> DataFrame:
    """(id, label) of about ``max_rows`` ids at most, chosen by a hash of the id."""
    one = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max((F.col(label_col) == 1).cast("int")).alias("_label"))
    n = one.count()
    share = min(1.0, max_rows / max(n, 1))
    return one if share == 1 else one.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < int(share * (1 << 30)))


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_labelled: int = 200_000, exceptions: tuple[str, ...] = EXCEPTIONS, min_log_odds: float = 1.0, ridge: float = 0.3) -> ToxicityModel:
    """Learns the lexicon and its weights from labelled rows.

    ``max_labelled`` bounds the labelled rows used, and with them the broadcast of their ids
    and what the driver sees of them: the numbers of the entries that each of them has. An
    entry is let in when three toxic texts have it, its log-likelihood ratio between the
    classes passes a Bonferroni bound over all entries seen, and its log-odds reach
    ``min_log_odds``; the rule is the same at every size, and no entry that passes is left out.
    """
    bounded_batches(docs.sparkSession)
    sample = labelled_sample(labels, id_col, label_col, max_labelled)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    known = rows.join(F.broadcast(sample), "_id").groupBy(F.sha2(F.coalesce("_text", F.lit("")), 256).alias("_sha")).agg(F.min("_id").alias("_id"), F.max("_label").alias("_label"))
    known = cut_lineage(known)  # one id of each distinct labelled text, max_labelled rows at most
    train = rows.join(F.broadcast(known), (rows["_id"] == known["_id"]) & (F.sha2(F.coalesce("_text", F.lit("")), 256) == known["_sha"])).select("_text", "_label")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = (Counter(), Counter())
        for batch in batches:
            for text, label in zip(batch["_text"], batch["_label"], strict=True):
                seen[label].update(entries_of(folded_words(text)) | {b""})
            if len(seen[0]) + len(seen[1]) > 500_000:
                yield counted(seen)
                seen = (Counter(), Counter())
        yield counted(seen)

    def counted(seen: tuple[Counter, Counter]) -> pd.DataFrame:
        words = [*{*seen[0], *seen[1]}]
        return pd.DataFrame({"word": words, "clean": [seen[0][w] for w in words], "toxic": [seen[1][w] for w in words]})

    counts = cut_lineage(train.mapInPandas(count, "word binary, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")))
    totals = counts.agg(F.sum(F.when(F.length("word") == 0, F.col("clean"))).alias("c"), F.sum(F.when(F.length("word") == 0, F.col("toxic"))).alias("t"), F.count("*").alias("v")).first()
    n_clean, n_toxic = int(totals["c"] or 0), int(totals["t"] or 0)
    share = n_toxic / max(n_clean + n_toxic, 1)
    empty = ToxicityModel(exceptions=exceptions, intercept=_logit(min(share, 0.4)))
    if not n_clean or not n_toxic:
        return empty
    t, c = F.col("toxic").cast("double"), F.col("clean").cast("double")
    p, p0 = t / (t + c), F.lit(share)
    ratio = 2 * (t * F.log(p / p0) + F.when(c > 0, c * F.log((1 - p) / (1 - p0))).otherwise(0.0))
    odds = F.log(((t + 0.5) / (n_toxic + 1)) / ((c + 0.5) / (n_clean + 1)))
    picked = counts.where((F.length("word") > 1) & (F.col("toxic") >= 3)).where((p > p0) & (ratio >= 2 * math.log(10 * max(int(totals["v"]), 1))) & (odds >= min_log_odds)).select("word").collect()
    if not picked:
        return empty
    entries = tuple(sorted(bytes(r["word"]) for r in picked))

    @F.pandas_udf("entries array<int>, length double")
    def hits(texts: pd.Series) -> pd.DataFrame:
        found = [text_hits(_automaton(entries, exceptions), x) for x in texts]
        return pd.DataFrame({"entries": [x[0] for x in found], "length": [x[2] for x in found]})

    shown = train.select("_label", hits("_text").alias("h")).select("_label", "h.*").toPandas()  # max_labelled rows at most
    weights, intercept = _fit_logistic(shown, len(entries), ridge)
    return ToxicityModel(tuple(zip(entries, weights.round(4).tolist(), strict=True)), exceptions, intercept, {"entries": len(entries), "labelled": n_clean + n_toxic})


def _logit(p: float) -> float:
    p = min(max(p, 1e-6), 1 - 1e-6)
    return math.log(p / (1 - p))


def _fit_logistic(shown: pd.DataFrame, n: int, ridge: float, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights (0 at least) and intercept by scaled gradient steps on rows of (label, entries, length)."""
    y, sizes = shown["_label"].to_numpy(dtype=float), np.array([len(x) for x in shown["entries"]])
    row = np.repeat(np.arange(len(y)), sizes)
    entry = np.concatenate([np.zeros(0, dtype=np.int64), *shown["entries"]]).astype(np.int64)
    x = 1 / np.repeat(shown["length"].to_numpy(), sizes)
    w, b = np.zeros(n), _logit(y.mean())
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(b + np.bincount(row, w[entry] * x, minlength=len(y)), -30, 30)))
        slope = np.bincount(entry, (p - y)[row] * x, minlength=n) + ridge / 25 * w
        bend = np.bincount(entry, (p * (1 - p))[row] * x * x, minlength=n) + ridge / 25
        w = np.maximum(w - 0.3 * slope / (3 * bend), 0)
        b -= 0.3 * (p - y).sum() / ((p * (1 - p)).sum() + 1e-9)
    return w, float(b)


def score_toxicity(docs: DataFrame, model: ToxicityModel, *, text_col: str = "text", score_col: str = "score", hits_col: str = "n_hits") -> DataFrame:
    """``docs`` with a score from 0 to 1 and the number of lexicon hits that count."""
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("score double, hits long")
    def scored(texts: pd.Series) -> pd.DataFrame:
        load = [toxic_load(model, x) for x in texts]
        z = np.array([model.intercept + x for x, _ in load], dtype=float)
        return pd.DataFrame({"score": 1 / (1 + np.exp(-np.clip(z, -30, 30))), "hits": np.array([k for _, k in load], dtype="int64")})

    both = fresh_name(docs, "_toxicity")
    return docs.withColumn(both, scored(F.col(text_col))).withColumns({score_col: F.col(f"{both}.score"), hits_col: F.col(f"{both}.hits")}).drop(both)

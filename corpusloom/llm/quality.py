"""Quality rules: counts with fixed limits, and a calibrated logistic regression on hashed n-grams.

A text's features are its words, pairs of words and runs of two to four bytes, lower-cased
and hashed into 2**bits buckets; a bucket's value is the logarithm of one plus its count,
and a text's values have length one. Weights are learned on a bounded sample of labelled
rows; a part of the sample that the weights have not seen turns their sum into a probability
(Platt's two parameters). Texts are scored in Arrow batches. A text is kept if the fixed
limits let it pass and its probability of being good reaches ``keep_at``.

Defined results: null and empty texts have no words and fail the limits. Without labelled
rows of both classes every probability is 1. Labels with a null are not used, and of
contradicting labels of one id or text the good one counts; equal labelled texts are learned
from once. Repeated rows are scored one by one. Other columns are carried along, but for
those of the output's names, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.scan import bounded_batches
from corpusloom.llm.toxicity import labelled_sample
from corpusloom.session import cut_lineage, fresh_name

BITS = 14
RUNS = (2, 3, 4)
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEATED = 50, 50  # words, and percent of words in repeated windows
_MIX, _PRIME = np.uint32(0x9E3779B1), np.uint64(0x100000001B3)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: list[bytes], size: int = 3) -> int:
    """Words that stand in a window of ``size`` words that the text has twice or more."""
    if len(words) <= size:
        return 0
    number: dict[bytes, int] = {}
    window = ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
    for n in range(1, size):  # a window's number: that of the one a word shorter, and the next word's
        _, window = np.unique(window[:-1] * len(number) + ids[n:], return_inverse=True)
    again = np.bincount(window)[window] > 1
    hit = np.zeros(len(words), dtype=bool)
    for n in range(size):
        hit[n : n + len(again)] |= again
    return int(hit.sum())


def counts_of(text: str | None) -> tuple[int, int, int, int, int]:
    """The numbers named by COUNTS; words are divided by blanks and the controls from tab to carriage return."""
    text = text or ""
    data = text.encode()
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    return len(words), chars, sum(map(text.count, SYMBOLS)), len(lines) - len({*lines}), repeated_words(words)


@lru_cache(maxsize=8)
def _powers(n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, dtype=np.uint64), np.cumprod(np.full(n - 1, _PRIME))])


def _buckets(h: np.ndarray, kind: int, bits: int) -> np.ndarray:
    h = (h ^ (h >> np.uint32(15))) * (_MIX + np.uint32(2 * kind))
    return ((h ^ (h >> np.uint32(13))) * _MIX) >> np.uint32(32 - bits)


def features(text: str | None, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the text's n-grams and their values."""
    data = (text or "").lower().encode()
    found = []
    raw = np.frombuffer(data, dtype=np.uint8)
    h = raw.astype(np.uint32)
    for n in range(2, max(RUNS) + 1):
        if len(raw) >= n:
            h = h[:-1] * np.uint32(0x01000193) + raw[n - 1 :]
            if n in RUNS:
                found.append(_buckets(h, n, bits))
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8))
    start, stop = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if len(start):
        size = stop - start
        letters = raw[~blank].astype(np.uint64) + np.uint64(1)
        first = np.cumsum(size) - size
        at = np.arange(len(letters)) - np.repeat(first, size)
        longest = 1 << int(size.max()).bit_length()
        word = np.add.reduceat(letters * _powers(longest)[at], first)
        fold = lambda x: (x ^ (x >> np.uint64(32))).astype(np.uint32)
        found.append(_buckets(fold(word), 17, bits))
        found.append(_buckets(fold(word[:-1] * np.uint64(0x9E3779B97F4A7C15) + word[1:]), 29, bits))
    if not found:
        return np.zeros(0, dtype=np.uint16), np.zeros(0, dtype=np.float32)
    counts = np.bincount(np.concatenate(found), minlength=1 << bits)
    buckets = np.flatnonzero(counts)
    values = np.log1p(counts[buckets])
    return buckets.astype(np.uint16 if bits <= 16 else np.uint32), (values / max(np.linalg.norm(values), 1e-12)).astype(np.float32)


@dataclass(frozen=True)
class QualityModel:
    """Weights by bucket, and what turns their sum into a probability; no weights: 1."""

    weights: np.ndarray | None = None
    intercept: float = 0.0
    slope: float = 1.0
    shift: float = 0.0
    bits: int = BITS
    report: dict = field(default_factory=dict)

    def probability(self, text: str | None) -> float:
        if self.weights is None:
            return 1.0
        buckets, values = features(text, self.bits)
        return float(_sigmoid(self.slope * (self.weights[buckets] @ values + self.intercept) + self.shift))


def _sigmoid(z: np.ndarray | float) -> np.ndarray | float:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _fit_logistic(rows: pd.DataFrame, n: int, ridge: float, steps: int) -> tuple[np.ndarray, float]:
    """Weights and intercept by accelerated gradient steps; rows: (buckets, values, label)."""
    y, sizes = rows["label"].to_numpy(dtype=np.float64), rows["buckets"].map(len).to_numpy()
    at, x, row = np.concatenate(rows["buckets"].to_list()), np.concatenate(rows["values"].to_list()), np.repeat(np.arange(len(rows)), sizes)
    w, b, last_w, last_b = np.zeros(n), 0.0, np.zeros(n), 0.0
    rate = 1 / (0.25 * 2 + ridge)  # rows have length one, and the intercept another
    for t in range(steps):
        push = t / (t + 3)
        look_w, look_b = w + push * (w - last_w), b + push * (b - last_b)
        wrong = _sigmoid(np.bincount(row, look_w[at] * x, minlength=len(y)) + look_b) - y
        last_w, last_b = w, b
        w = look_w - rate * (np.bincount(at, wrong[row] * x, minlength=n) / len(y) + ridge * look_w)
        b = look_b - rate * wrong.mean()
    return w, b


def _calibrate(z: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and shift by Newton's steps against Platt's smoothed targets."""
    good, bad = y.sum(), len(y) - y.sum()
    target = np.where(y == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    a, c = 1.0, 0.0
    for _ in range(rounds):
        p = _sigmoid(a * z + c)
        e, s = p - target, np.maximum(p * (1 - p), 1e-9)
        g = np.array([(e * z).sum(), e.sum()])
        h = np.array([[(s * z * z).sum() + 1e-6, (s * z).sum()], [(s * z).sum(), s.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, c = a - float(np.clip(step[0], -1, 1)), c - float(np.clip(step[1], -1, 1))
    return max(a, 1e-3), c


def fit_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = 4_000, bits: int = BITS, ridge: float = 1e-4, steps: int = 100) -> QualityModel:
    """Learns from about ``max_labelled`` labelled rows at most, chosen by a hash of the id.

    That number bounds the broadcast of ids and what the driver sees: whole texts are turned
    into features in tasks, of 2**bits values a row at most. A fifth of the rows, by a hash
    of the text, calibrates.
    """
    bounded_batches(docs.sparkSession)
    sample = labelled_sample(labels, id_col, label_col, max_labelled)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    known = rows.join(F.broadcast(sample), "_id").select(F.sha2(F.coalesce("_text", F.lit("")), 256).alias("sha"), "_text", "_label")

    def turn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [features(x, bits) for x in batch["_text"]]
            yield pd.DataFrame({"sha": batch["sha"], "label": batch["_label"], "buckets": [b.tobytes() for b, _ in made], "value": [v.tobytes() for _, v in made]})

    turned = cut_lineage(known.mapInPandas(turn, "sha string, label int, buckets binary, value binary"))
    shown = turned.toPandas().sort_values(["sha", "label"], ascending=[True, False]).drop_duplicates("sha")  # max_labelled rows, about
    if shown["label"].nunique() < 2:
        return QualityModel(bits=bits)
    kind = np.uint16 if bits <= 16 else np.uint32
    data = pd.DataFrame({"buckets": [np.frombuffer(x, dtype=kind) for x in shown["buckets"]], "values": [np.frombuffer(x, dtype=np.float32) for x in shown["value"]], "label": shown["label"].to_numpy()})
    held = shown["sha"].str[:8].map(lambda x: int(x, 16) % 5 == 0).to_numpy()
    if data[~held]["label"].nunique() < 2:
        held[:] = False
    w, b = _fit_logistic(data[~held], 1 << bits, ridge, steps)
    aside = data[held]
    slope, shift = 1.0, 0.0
    if aside["label"].nunique() == 2:
        z = np.array([w[i] @ v + b for i, v in zip(aside["buckets"], aside["values"], strict=True)])
        slope, shift = _calibrate(z, aside["label"].to_numpy())
    return QualityModel(w.astype(np.float32), float(b), slope, shift, bits, {"labelled": len(data), "held": int(held.sum())})


def score_quality(docs: DataFrame, model: QualityModel, *, text_col: str = "text", keep_at: float = 0.5, min_words: int = MIN_WORDS, max_repeated: int = MAX_REPEATED) -> DataFrame:
    """``docs`` with the counts, ``base_failed``, ``quality`` (the probability of being good) and ``kept``."""
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(", ".join(f"{c} long" for c in COUNTS) + ", quality double")
    def measured(texts: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame([counts_of(x) for x in texts], columns=list(COUNTS), dtype="int64")
        out["quality"] = np.array([sent.value.probability(x) for x in texts], dtype=float)
        return out

    both = fresh_name(docs, "_quality")
    rows = docs.withColumn(both, measured(F.col(text_col)))
    got = lambda c: F.col(f"{both}.{c}")
    failed = (got("n_words") < min_words) | (100 * got("n_repeat_words") > max_repeated * got("n_words"))
    named = {c: got(c) for c in (*COUNTS, "quality")} | {"base_failed": failed, "kept": ~failed & (got("quality") >= keep_at)}
    taken = {c.lower() for c in named}
    return rows.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() not in taken), *(c.alias(name) for name, c in named.items()))

"""Per-text helpers that SQL cannot say: JSON repair, outlines, representative passages."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

HEADINGS = (
    re.compile(r"^#{1,6}\s+(.+)$"),
    re.compile(r"^((?:chapter|section|part|appendix)\s+\w+.*)$", re.I),
    re.compile(r"^(\d+(?:\.\d+)*\.?\s+\S.*)$"),
    re.compile(r"^([A-Z][A-Z0-9 ,&-]{2,})$"),
    re.compile(r"^([A-Z][^.!?]{2,78}):$"),
)


def balanced(text: str) -> str | None:
    """The first balanced {...} or [...] of a text, strings respected; from its start if it never closes."""
    start = next((i for i, c in enumerate(text) if c in "{["), None)
    if start is None:
        return None
    depth, quoted, escaped = 0, False, False
    for i in range(start, len(text)):
        c = text[i]
        if escaped:
            escaped = False
        elif c == "\\":
            escaped = quoted
        elif c == '"':
            quoted = not quoted
        elif not quoted and c in "{[":
            depth += 1
        elif not quoted and c in "}]":
            depth -= 1
            if not depth:
                return text[start : i + 1]
    return text[start:]


def repaired(text: str | None) -> str | None:
    """JSON text that parses, from nearly-JSON: fences, control characters, stray and missing commas, open ends."""
    body = balanced(re.sub(r"```(?:json)?", "", text or ""))
    if body is None:
        return None
    out: list[str] = []
    closers: list[str] = []
    quoted = escaped = False
    for c in body:
        if quoted:
            if escaped:
                escaped = False
            elif c == "\\":
                escaped = True
            elif c == '"':
                quoted = False
            elif c < " ":
                c = {"\n": "\\n", "\r": "\\r", "\t": "\\t"}.get(c, "")
            out.append(c)
        elif c == '"':
            if re.search(r'(?:["}\]\d]|true|false|null)\s*$', "".join(out[-12:])):
                out.append(",")
            quoted = True
            out.append(c)
        elif c in "{[":
            closers.append("}" if c == "{" else "]")
            out.append(c)
        elif c in "}]":
            while out and out[-1] in ", \n\r\t":
                out.pop()
            if closers and closers[-1] == c:
                closers.pop()
                out.append(c)
        elif c >= " " or c in "\n\r\t":
            out.append(c)
    if quoted:
        out.append('"')
    while out and out[-1] in ", \n\r\t":
        out.pop()
    fixed = "".join(out) + "".join(reversed(closers))
    fixed = re.sub(r":\s*(?=[}\]]|$)", ": null", fixed)
    try:
        return json.dumps(json.loads(fixed), ensure_ascii=False, sort_keys=True)
    except ValueError:
        return None


def outline(text: str | None, most: int = 25) -> list[str]:
    """Headings in order, 3 to 80 characters, distinct whatever their case."""
    found: dict[str, str] = {}
    for line in (text or "").splitlines():
        line = line.strip()
        for pattern in HEADINGS:
            m = pattern.match(line)
            if m and 3 <= len(m[1].strip()) <= 80:
                found.setdefault(m[1].strip().lower(), m[1].strip())
                break
    return list(found.values())[:most]


def snapped(text: str, at: int, reach: int = 300) -> int:
    """The paragraph's start nearest to a place within reach, else the place."""
    cuts = [m.end() for m in re.finditer(r"\n\s*\n", text[max(at - reach, 0) : at + reach])]
    return min((max(at - reach, 0) + c for c in cuts), key=lambda c: abs(c - at), default=at)


def representative(text: str | None, budget: int = 16_000) -> str:
    """Outline (5 %), head (37 %), four samples of the middle and tail (16 %) of a long text; a short one whole."""
    text = text or ""
    if len(text) <= budget:
        return text
    heads = "\n".join(outline(text))[: int(0.05 * budget)]
    head, tail = text[: int(0.37 * budget)], text[-int(0.16 * budget) :]
    each = (budget - len(heads) - len(head) - len(tail)) // 4
    room = len(text) - len(head) - len(tail)
    samples = []
    for k in range(4):
        at = snapped(text, len(head) + room * (2 * k + 1) // 8 - each // 2)
        samples.append(text[at : at + each])
    return "\n\n---\n\n".join(x.strip() for x in (heads, head, *samples, tail) if x.strip())


@F.pandas_udf(StringType())
def repair_json(texts: pd.Series) -> pd.Series:
    return pd.Series([repaired(x) for x in texts], dtype=object)


@F.pandas_udf(ArrayType(StringType()))
def outline_of(texts: pd.Series) -> pd.Series:
    return pd.Series([outline(x) for x in texts], dtype=object)


@F.pandas_udf(StringType())
def representative_content(texts: pd.Series) -> pd.Series:
    return pd.Series([representative(x) for x in texts], dtype=object)


def hashing_embedder(dim: int = 64):
    """A stand-in for an embedding model: signed sums of hashed words, unit length."""
    import numpy as np
    import xxhash
    from pyspark.sql.types import FloatType

    @F.pandas_udf(ArrayType(FloatType()))
    def embed(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            v = np.zeros(dim)
            for w in (text or "").lower().split():
                h = xxhash.xxh64_intdigest(w.encode())
                v[h % dim] += 1 if h >> 63 else -1
            n = np.linalg.norm(v)
            out.append((v / n if n else v).astype("float32"))
        return pd.Series(out, dtype=object)

    return embed


def document_analyser(analyse):
    """A column function (text, file name) of a model given as ``analyse(text, name) -> dict``, null where it fails.

    The result is a struct of category, keywords and confidence; callers put a rule's answer in
    place of a null.
    """

    @F.pandas_udf("category string, keywords array<string>, confidence double")
    def analysed(texts: pd.Series, names: pd.Series) -> pd.DataFrame:
        rows = []
        for text, name in zip(texts, names, strict=True):
            try:
                got = analyse(text or "", name or "") or {}
                rows.append((got.get("category"), got.get("keywords"), got.get("confidence")))
            except Exception:  # a model's failure on one document is an answer: none
                rows.append((None, None, None))
        return pd.DataFrame(rows, columns=["category", "keywords", "confidence"])

    return analysed

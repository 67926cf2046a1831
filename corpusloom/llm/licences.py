"""Licence scans: Aho-Corasick for tags and notice phrases, shunting-yard for expressions.

Notice phrases are found among a text's words, identifier tags in the lower-cased text (names
that begin with LicenseRef- are their own tag). The rest of a tag's line is read as a licence expression: identifiers joined by OR, AND and
WITH (which binds closest), in parentheses if wanted. It is brought into postfix order with
an operator stack and evaluated: OR needs one permissive side, AND both, WITH keeps the
licence's own answer and adds the exception's name.

Labels are the base phrases' labels, those of the notices, and the lower-cased identifiers
of expressions. The score says how much there is: one minus the product, over distinct
labels, of what each leaves open (a tag 0.1, a notice 0.3, a base phrase 0.5); 0 without any.

Defined results: null and empty texts have no words and no labels, so score 0 and null
places; a malformed expression gives the identifiers that it has and no verdict; repeated
rows are scanned one by one; other columns are carried along, but for those of the output's
names, which are replaced.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.scan import automaton, line_of, places, bounded_batches, words_of
from corpusloom.session import fresh_name

#: Phrases of the contract.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notice phrases and the identifiers they stand for.
NOTICES = {
    "apache license version 2 0": "apache-2.0",
    "mit license": "mit",
    "gnu general public license version 2": "gpl-2.0",
    "gnu general public license version 3": "gpl-3.0",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "bsd 2 clause": "bsd-2-clause",
    "bsd 3 clause": "bsd-3-clause",
    "cc by 4 0": "cc-by-4.0",
    "cc by sa 4 0": "cc-by-sa-4.0",
    "cc by nc 4 0": "cc-by-nc-4.0",
    "creative commons attribution": "cc-by",
    "cc0 1 0": "cc0-1.0",
    "public domain": "public-domain",
}
TAGS = ("spdx-license-identifier:", "@license", "licenseref-")  # the last one is part of an identifier itself
PERMISSIVE = ("mit", "apache", "bsd", "isc", "cc0", "cc-by-4.0", "cc-by-3.0", "unlicense", "zlib", "public-domain")
PRECEDENCE = {"or": 1, "and": 2, "with": 3}
_TOKEN = re.compile(r"[()]|[a-z0-9](?:[a-z0-9.+:-]*[a-z0-9+])?")


def parse_expression(text: str) -> list[str] | None:
    """Postfix order of a licence expression; None if it is malformed."""
    text = text.lower()
    return read_expression(text, 0, len(text))[0]


def read_expression(lower: str, start: int, stop: int) -> tuple[list[str] | None, set[str]]:
    """Postfix order (None if malformed) and all identifiers of the expression at ``start``, up to where prose begins.

    Prose begins with a name or an opening parenthesis behind a name, or a closing one too many.
    """
    out: list[str] = []
    stack: list[str] = []
    names: set[str] = set()
    wants_name = good = True
    for found in _TOKEN.finditer(lower, start, stop):
        token = found[0]
        if token in PRECEDENCE:
            good &= not wants_name
            while stack and stack[-1] != "(" and PRECEDENCE[stack[-1]] >= PRECEDENCE[token]:
                out.append(stack.pop())
            stack.append(token)
            wants_name = True
        elif token == "(":
            if not wants_name:
                good = False
                break
            stack.append(token)
        elif token == ")":
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                good = False
                break
            good &= not wants_name
            wants_name = False
            stack.pop()
        elif not wants_name:
            break  # prose after the expression
        else:
            out.append(token)
            names.add(token)
            wants_name = False
    if not good or wants_name or "(" in stack:
        return None, names
    return out + stack[::-1], names


def evaluate(postfix: list[str]) -> tuple[set[str], bool]:
    """Identifiers of an expression, and whether it can be used permissively."""
    values: list[bool] = []
    for token in postfix:
        if token in PRECEDENCE:
            b, a = values.pop(), values.pop()
            values.append(a or b if token == "or" else a and b if token == "and" else a)
        else:
            values.append(token.startswith(PERMISSIVE))
    return {t for t in postfix if t not in PRECEDENCE}, values[0]


@lru_cache(maxsize=1)
def _automata():
    both = {phrase.encode(): (BASE.get(phrase), NOTICES.get(phrase)) for phrase in {**BASE, **NOTICES}}
    tags = ahocorasick.Automaton()
    for tag in TAGS:
        tags.add_word(tag, tag)
    tags.make_automaton()
    return automaton(both), tags


def scan_text(text: str | None) -> dict[str, object]:
    """What one text shows: base places, labels, permissive verdict of its expressions, score."""
    phrases, tags = _automata()
    words = words_of(text)
    line = line_of(words)
    starts, base, weights, verdicts = [], set(), {}, []
    for at, _, (label, notice) in places(phrases, line):
        if label:
            starts.append(at)
            base.add(label)
            weights[label] = max(weights.get(label, 0), 0.5)
        if notice:
            weights[notice] = max(weights.get(notice, 0), 0.7)
    lower, read = (text or "").lower(), 0
    for end, tag in tags.iter(lower):
        start = end + 1 - (len(tag) if tag == TAGS[-1] else 0)
        if start < read:
            continue  # inside an expression that has been read
        stop = lower.find("\n", end + 1)
        read = len(lower) if stop < 0 else stop
        postfix, names = read_expression(lower, start, read)
        if postfix:
            verdicts.append(evaluate(postfix)[1])
        for name in names:
            weights[name] = 0.9
    count = (lambda at: line.count(" ", 0, at))
    return {
        "n_words": len(words), "n_base": len(starts), "first_word": count(min(starts)) if starts else None, "last_word": count(max(starts)) if starts else None,
        "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(weights)), "score": 1 - math.prod(1 - w for w in weights.values()), "permissive": all(verdicts) if verdicts else None,
    }


FIELDS = {"n_words": "long", "n_base": "long", "first_word": "long", "last_word": "long", "base_labels": "string", "labels": "string", "score": "double", "permissive": "boolean"}


def scan_licences(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``docs`` with the columns of ``FIELDS``, which replace columns of those names."""
    bounded_batches(docs.sparkSession)

    @F.pandas_udf(", ".join(f"{k} {v}" for k, v in FIELDS.items()))
    def scanned(texts: pd.Series) -> pd.DataFrame:
        rows = [scan_text(x) for x in texts]
        return pd.DataFrame({k: pd.array([r[k] for r in rows], dtype={"long": "Int64", "boolean": "boolean", "double": "float64"}.get(v, "object")) for k, v in FIELDS.items()})

    got = fresh_name(docs, "_licence")
    return docs.withColumn(got, scanned(F.col(text_col))).withColumns({k: F.col(f"{got}.{k}") for k in FIELDS}).drop(got)

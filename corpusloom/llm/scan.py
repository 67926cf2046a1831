"""Small text helpers that tasks share: word lines and Aho-Corasick automata."""

from __future__ import annotations

import ahocorasick
from pyspark.sql import SparkSession

# Fixed by the word pattern [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z.
WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def bounded_batches(spark: SparkSession, size: str = "4m") -> None:
    """Texts can be very long, so what Python workers get at a time is bounded in bytes; short rows go on in large batches."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def words_of(text: str | None, table: bytes = WORD_BYTES) -> list[bytes]:
    """The words of a text as UTF-8; none for null."""
    return (text or "").encode().translate(table).split()


def line_of(words: list[bytes]) -> str:
    """One latin-1 character a byte, one blank around every word: what automata read."""
    return f" {b' '.join(words).decode('latin-1')} "


def automaton(phrases: dict[bytes, object]) -> ahocorasick.Automaton:
    """Finds each phrase (words joined by one blank) at word boundaries of a line_of()."""
    found = ahocorasick.Automaton()
    for phrase, value in phrases.items():
        key = line_of(phrase.split())
        found.add_word(key, (len(key), value))
    if phrases:
        found.make_automaton()
    return found


def places(found: ahocorasick.Automaton, line: str) -> list[tuple[int, int, object]]:
    """(start, end, value) of every match, blanks included, by end then length."""
    if not len(found):
        return []
    return [(end + 1 - n, end + 1, value) for end, (n, value) in found.iter(line)]

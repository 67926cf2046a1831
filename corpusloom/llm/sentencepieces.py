"""SentencePiece encoding with byte offsets, and decoding.

Normalisation walks the text with longest-prefix matches in the model's compiled character
map and records, for every normalised byte, the original byte it came from; blanks become
the meta symbol and a dummy prefix may be added. Pieces of the normalised text are merged
best score first, and every piece is projected through the alignment to the span of
original bytes that it stands for. Spans of a text follow each other without gaps.

Where no piece of the vocabulary has the meta symbol behind another character, merges never
cross into a new word, so words are encoded one by one and remembered; the vocabulary is
tested for that, and without it texts are encoded as a whole.

Defined results: a null text counts as empty (begin and end ids only); repeated rows are
encoded one by one; other columns are carried along whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.scan import bounded_batches
from corpusloom.session import fresh_name

META = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # fixed values: piece types of the model format
FIELDS = {"ids": "array<int>", "begins": "array<int>", "ends": "array<int>", "decoded": "string", "n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string", "n_bytes": "long"}
REMEMBERED_WORD, REMEMBERED = 64, 700_000  # characters of a word, and words, that a worker remembers


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protocol buffer message: ints, 4-byte and length-delimited values."""
    at = 0

    def varint(at: int) -> tuple[int, int]:
        shift = value = 0
        while True:
            value |= (data[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if data[at - 1] < 128:
                return value, at

    while at < len(data):
        tag, at = varint(at)
        if tag & 7 == 0:
            value, at = varint(at)
        elif tag & 7 == 2:
            n, at = varint(at)
            value, at = data[at : at + n], at + n
        else:
            n = 4 if tag & 7 == 5 else 8
            value, at = data[at : at + n], at + n
        yield tag >> 3, value


class CharacterMap:
    """The compiled map: a double array of byte prefixes, then NUL-ended replacements."""

    def __init__(self, blob: bytes):
        n = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", n // 4, 4).tolist() if blob else []
        self.texts = blob[4 + n :] if blob else b""

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Bytes matched at ``at`` and their replacement, for the longest key there."""
        if not self.units:
            return None
        best, node = None, 0
        offset = lambda u: (u >> 10) << ((u & (1 << 9)) >> 6)
        node ^= offset(self.units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            unit = self.units[node] if node < len(self.units) else 0
            if unit & ((1 << 31) | 0xFF) != data[i]:
                break
            node ^= offset(unit)
            if unit >> 8 & 1:
                start = self.units[node] & ((1 << 31) - 1)
                best = (i + 1 - at, self.texts[start : self.texts.index(b"\0", start)])
        return best


@dataclass
class Encoding:
    ids: np.ndarray
    sizes: np.ndarray  # original bytes of each piece; their running sum gives the spans


class SentencePieces:
    """A BPE model file, as a codec with offsets."""

    def __init__(self, blob: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.types: list[int] = []
        prefix, squeeze, escape, charsmap, kind = True, True, True, b"", 1
        for number, value in _fields(blob):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece[1].decode())
                self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.types.append(piece.get(3, NORMAL))
            elif number == 2:
                kind = dict(_fields(value)).get(3, 1)
            elif number == 3:
                spec = dict(_fields(value))
                charsmap, prefix, squeeze, escape = spec.get(2, b""), bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1))
        if kind != 2:
            raise ValueError("only BPE models are supported")
        self.map, self.prefix, self.squeeze, self.blank = CharacterMap(charsmap), prefix, squeeze, META if escape else " "
        self.id_of = {p: i for i, (p, t) in enumerate(zip(self.pieces, self.types, strict=True)) if t in (NORMAL, USER_DEFINED, UNUSED)}
        self.bytes_id = {int(p[1:-1], 16): i for i, (p, t) in enumerate(zip(self.pieces, self.types, strict=True)) if t == BYTE}
        self.byte_of = {i: b for b, i in self.bytes_id.items()}
        self.unknown = self.types.index(UNKNOWN)
        controls = {p: i for i, (p, t) in enumerate(zip(self.pieces, self.types, strict=True)) if t == CONTROL}
        self.begin, self.end = controls["<s>"], controls["</s>"]
        user = sorted((p for p, t in zip(self.pieces, self.types, strict=True) if t == USER_DEFINED), key=len, reverse=True)
        self.user = re.compile("(" + "|".join(map(re.escape, user)) + ")") if user else None
        within = any(self.blank in p.lstrip(self.blank) for p in self.id_of)
        self.by_word = not within and not user and not any(t == UNUSED for t in self.types) and bool(self.bytes_id)
        self.words = re.compile(self._stretches())
        self.plain = not charsmap and not self.squeeze  # every character stands for itself
        # Every way to make a piece of two others: its score's rank, and the piece.
        order = {x: k for k, x in enumerate(sorted({self.scores[i] for i in self.id_of.values()}, reverse=True))}
        made = {self.id_of[p[:k]] << 20 | self.id_of[p[k:]]: i for p, i in self.id_of.items() for k in range(1, len(p)) if p[:k] in self.id_of and p[k:] in self.id_of}
        self.pair_piece, self.pair_rank = made, {key: order[self.scores[i]] for key, i in made.items()}
        # Original bytes of a piece in a text whose blanks became META; a byte piece has one.
        self.own_size = np.array([1 if t == BYTE else 0 if t == CONTROL else len(p.encode()) - 2 * p.count(META) for p, t in zip(self.pieces, self.types, strict=True)])
        self.frame = [np.array([i], dtype="<i4").tobytes() for i in (self.begin, self.end)]
        self.runs = re.compile(f"{self.blank}+[^{self.blank}]*")
        surface = {CONTROL: lambda i: b"", UNKNOWN: lambda i: " ⁇ ".encode(), BYTE: lambda i: bytes([self.byte_of[i]])}
        self.surface = [surface.get(t, lambda i: self.pieces[i].replace(self.blank, " ").encode())(i) for i, t in enumerate(self.types)]
        self.known_words: dict[str, bytes] = {}
        self.known_stretches: dict[str, bytes] = {}

    def _stretches(self) -> str:
        """A pattern for stretches of normalised text that no piece reaches across.

        A word begins at its blanks. Letters end at a sign that the vocabulary never has
        behind a letter, so that fewer different stretches are left to remember.
        """
        signs = set("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~") - {b for p in self.id_of for a, b in zip(p, p[1:], strict=False) if a.isalpha()}
        blank, end = self.blank, "".join(map(re.escape, sorted(signs)))
        return (f"{blank}+[^\\W\\d_]+(?=[{end}])|" if end else "") + f"{blank}+[^{blank}]*|[^{blank}]+"

    def normalise(self, text: str) -> tuple[str, list[int]]:
        """The normalised text and, for each of its characters, how many original bytes it stands for."""
        out: list[str] = []
        size: list[int] = []
        if self.plain:
            out, size = list(text.replace(" ", self.blank)), [len(c.encode()) for c in text]
        else:
            data, at, lost = text.encode(), 0, 0
            while at < len(data):
                n, to = self.map.longest(data, at) or (0, b"")
                if not n:
                    n = 1 if data[at] < 128 else 2 if data[at] < 224 else 3 if data[at] < 240 else 4
                    to = data[at : at + n]
                lost, at = lost + n, at + n
                for c in to.decode():
                    if c == " " and self.squeeze and (not out or out[-1] == " "):
                        continue
                    out.append(c)
                    size.append(lost)
                    lost = 0
            if self.squeeze and out and out[-1] == " ":
                out.pop()
                lost += size.pop()
            if lost and size:
                size[-1] += lost
            out = [self.blank if c == " " else c for c in out]
        if self.prefix and out:
            out.insert(0, self.blank)
            size.insert(0, 0)
        return "".join(out), size

    def merge(self, text: str) -> list[str]:
        """Pieces of a stretch of normalised text: the best-scored adjacent pair first, the leftmost of equals."""
        n, id_of, scores = len(text), self.id_of, self.scores
        part: list[str] = list(text)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list[tuple[float, int, int, str]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (both := part[a] + part[b]) in id_of:
                heapq.heappush(heap, (-scores[id_of[both]], a, b, both))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, a, b, both = heapq.heappop(heap)
            if part[a] + part[b] != both or not part[a] or not part[b] or after[a] != b:
                continue
            part[a], part[b] = both, ""
            after[a] = after[b]
            if after[b] >= 0:
                before[after[b]] = a
            offer(before[a], a)
            offer(a, after[a])
        return [p for p in part if p]

    def _merge_ids(self, text: str) -> list[int]:
        """The same for a few characters, on ids; -1 stands for a character without a piece.

        Looking at all pairs is quicker here than a heap; ``index`` finds the leftmost of equals.
        """
        part, rank, none = [self.id_of.get(c, -1) for c in text], self.pair_rank.get, 1 << 30
        ranks = [rank(a << 20 | b, none) for a, b in zip(part, part[1:], strict=False)]
        while ranks and (best := min(ranks)) < none:
            i = ranks.index(best)
            part[i] = new = self.pair_piece[part[i] << 20 | part[i + 1]]
            del part[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank(part[i - 1] << 20 | new, none)
            if i < len(ranks):
                ranks[i] = rank(new << 20 | part[i + 1], none)
        return part

    def _word(self, text: str, size: list[int]) -> tuple[list[int], list[int]]:
        """Ids and original bytes of each piece of a stretch; ``size`` is that of its characters."""
        ids: list[int] = []
        sizes: list[int] = []
        at = 0
        for piece in self.merge(text):
            own = sum(size[at : at + len(piece)])
            at += len(piece)
            known = self.id_of.get(piece)
            if known is not None:
                ids.append(known)
                sizes.append(own)
            elif self.bytes_id:
                raw = piece.encode()
                ids += [self.bytes_id[b] for b in raw]
                sizes += [1] * len(raw) if own == len(raw) else [*[0] * (len(raw) - 1), own]
            elif ids and ids[-1] == self.unknown:
                sizes[-1] += own
            else:
                ids.append(self.unknown)
                sizes.append(own)
        return ids, sizes

    def encode(self, text: str | None) -> Encoding:
        """Ids with begin and end, and original bytes of each."""
        ids, sizes = [self.begin], [0]
        text = text or ""
        if self.plain and self.by_word and self.prefix and self.blank not in text:
            ids = self._by_words(text) if text else np.array([self.begin, self.end], dtype="<i4")
            sizes = self.own_size[ids]
            if text:
                sizes[1] -= 1  # the dummy prefix, counted as a blank
            return Encoding(ids, sizes)
        if text:
            line, size = self.normalise(text)
            stretches = self.words.findall(line) if self.by_word else self.user.split(line) if self.user else [line]
            at = 0
            for word in filter(None, stretches):
                got = ([self.id_of[word]], [sum(size[at : at + len(word)])]) if self.user and self.user.fullmatch(word) else self._word(word, size[at : at + len(word)])
                at += len(word)
                ids += got[0]
                sizes += got[1]
        return Encoding(np.array([*ids, self.end], dtype="<i4"), np.array([*sizes, 0]))

    def _by_words(self, text: str) -> np.ndarray:
        """Ids of a text in which every blank begins a word, from remembered words and stretches."""
        words, stretches = self.known_words, self.known_stretches
        parts = text.split(" ") if text[0] != " " and "  " not in text else [w[1:] for w in self.runs.findall(self.blank + text.replace(" ", self.blank))]
        if len(words) > REMEMBERED:
            words.clear()
        if len(stretches) > REMEMBERED:
            stretches.clear()
        new = set(parts).difference(words)
        for part in new:
            ids = []
            for s in self.words.findall(self.blank + part):
                got = stretches.get(s)
                if got is None:
                    pieces = self._merge_ids(s) if len(s) <= REMEMBERED_WORD else [-1]
                    if -1 in pieces:
                        pieces, _ = self._word(s, [1] * len(s))
                    got = np.array(pieces, dtype="<i4").tobytes()
                    if len(s) <= REMEMBERED_WORD:
                        stretches[s] = got
                ids.append(got)
            words[part] = b"".join(ids)
        ids = b"".join([self.frame[0], *map(words.__getitem__, parts), self.frame[1]])
        for part in new:
            if len(part) > REMEMBERED_WORD:
                del words[part]
        return np.frombuffer(ids, dtype="<i4")

    def decode(self, ids: list[int]) -> str:
        """The text of ids: bytes joined where they are UTF-8, the dummy prefix taken off once."""
        if self.prefix:
            first = next((k for k, i in enumerate(ids) if self.types[i] != CONTROL), len(ids))
            lead = first < len(ids) and self.types[ids[first]] == NORMAL and self.pieces[ids[first]].startswith(self.blank)
        else:
            lead = False
        try:  # bytes of all pieces at once, if they are UTF-8
            return b"".join(map(self.surface.__getitem__, ids)).decode()[lead:]
        except UnicodeDecodeError:
            return self._decode_broken(ids)

    def _decode_broken(self, ids: list[int]) -> str:
        """Where byte pieces don't make up characters, each run of them is repaired on its own."""
        out: list[str] = []
        raw = bytearray()
        started = False

        def flush() -> None:
            if raw:
                out.append(raw.decode(errors="replace"))
                raw.clear()

        for i in ids:
            kind = self.types[i]
            if kind == BYTE:
                raw.append(self.byte_of[i])
                started = True
                continue
            flush()
            if kind == CONTROL:
                continue
            piece = " ⁇ " if kind == UNKNOWN else self.pieces[i]
            if not started and self.prefix and piece.startswith(self.blank):
                piece = piece[1:]
            started = True
            out.append(piece.replace(self.blank, " "))
        flush()
        return "".join(out)


@lru_cache(maxsize=2)
def load(blob: bytes) -> SentencePieces:
    return SentencePieces(blob)


def encode_pieces(docs: DataFrame, model_path: str, *, text_col: str = "text", fields: tuple[str, ...] = ("ids", "begins", "ends", "decoded")) -> DataFrame:
    """``docs`` with the asked-for fields of each text's encoding.

    ``ids`` (with begin and end), ``begins`` and ``ends`` (spans in the text's UTF-8 bytes),
    ``decoded``, ``n_tokens``, ``n_bytes`` (covered by the spans), and SHA-256 digests of the
    ids (little-endian unsigned 32-bit) and of the decoded text. The model file is read on the
    driver and sent once to each executor; its size doesn't grow with the data.
    """
    bounded_batches(docs.sparkSession)
    with open(model_path, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())
    schema = ", ".join(f"{name} {FIELDS[name]}" for name in fields)

    def one(codec: SentencePieces, text: str | None) -> dict[str, object]:
        got = codec.encode(text)
        ends = np.cumsum(got.sizes)
        decoded = codec.decode(got.ids.tolist()) if {"decoded", "decoded_sha256"} & {*fields} else ""
        value = {"ids": lambda: got.ids, "begins": lambda: ends - got.sizes, "ends": lambda: ends, "decoded": lambda: decoded, "n_tokens": lambda: len(got.ids), "n_bytes": lambda: int(ends[-1]), "ids_sha256": lambda: hashlib.sha256(got.ids.astype("<u4").tobytes()).hexdigest(), "decoded_sha256": lambda: hashlib.sha256(decoded.encode()).hexdigest()}
        return {name: value[name]() for name in fields}

    @F.pandas_udf(schema)
    def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = load(model.value)
        for texts in batches:
            rows = [one(codec, x) for x in texts]
            yield pd.DataFrame({name: [r[name] for r in rows] for name in fields})

    got = fresh_name(docs, "_pieces")
    return docs.withColumn(got, encoded(F.col(text_col))).withColumns({name: F.col(f"{got}.{name}") for name in fields}).drop(got)

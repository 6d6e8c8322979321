"""Byte-level BPE encoding by dynamic programming over prefixes, and decoding.

The encoding of every prefix of a piece ends in exactly one token. An automaton over
the vocabulary names, at each position, the tokens that end there; the one whose
border with the last token of the prefix before it would survive the merges is the
last token of this prefix. Following these back from the end gives the ids. The work
is linear in the text, for a piece of any length.

Texts are cut where the tokenizer's pattern always cuts, so equal pieces meet in
bounded caches and most of a text is looked up.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from collections.abc import Iterator
from functools import cached_property, lru_cache

import ahocorasick
import numpy as np
import regex
from pyspark.sql import DataFrame

from solvenza.llm.common import map_rows

# The pattern of the public byte-level tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

BYTES = 256
CACHED = 400_000       # entries of a cache; it starts anew when full
CACHED_CHARS = 64      # longer pieces are not cached

# The same for text of the first 256 code points, in classes that ``re`` knows.
_LETTER, _NUMBER, _SPACE = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", "\\t-\\r \\x85\\xa0"
LATIN_PATTERN = (
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_NUMBER}]+"
    rf"| ?[^{_SPACE}{_LETTER}{_NUMBER}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
)

# A space before something visible always starts a new piece.
_BEFORE_WORD = re.compile(r" (?=\S)")
_NO_WORD_AFTER = re.compile(r" (?!\S)")


def byte_letters() -> list[str]:
    """The vocabulary's letter of each byte: itself where printable, else from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = {b: 256 + i for i, b in enumerate(b for b in range(BYTES) if b not in set(printable))}
    return [chr(others.get(b, b)) for b in range(BYTES)]


class Bpe:
    """An encoder and decoder for the text of a byte-level BPE vocabulary file.

    Tokens are numbered by age inside: the bytes first, then one per merge in the
    order of the merges; ``ids`` has the vocabulary's id of each.
    """

    def __init__(self, spec: str):
        loaded = json.loads(spec)
        model = loaded["model"]
        to_byte = {letter: chr(b) for b, letter in enumerate(byte_letters())}
        plain = lambda token: "".join(map(to_byte.__getitem__, token))
        names = {b: chr(b) for b in range(BYTES)}
        age = {name: b for b, name in names.items()}
        self.parts: list[tuple[int, int]] = [(b, b) for b in range(BYTES)]
        self.merged: dict[tuple[int, int], int] = {}
        vocabulary = {plain(token): number for token, number in model["vocab"].items()}
        for merge in model["merges"]:
            left, right = (plain(x) for x in (merge.split(" ") if isinstance(merge, str) else merge))
            new = len(self.parts)
            self.parts.append((age[left], age[right]))
            self.merged.setdefault((age[left], age[right]), new)
            age.setdefault(left + right, new)
            names[new] = left + right
        self.ids = [vocabulary[names[i]] for i in range(len(self.parts))]
        self.packed = [struct.pack("<I", i) for i in self.ids]
        self.sizes = [len(names[i]) for i in range(len(self.parts))]
        self._age = age
        self.texts = {vocabulary[names[i]]: names[i].encode("latin-1") for i in range(len(self.parts))}
        special = loaded.get("added_tokens") or []
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in special):
            raise ValueError("added tokens that take in their surroundings are not supported")
        self.special = {t["content"]: t["id"] for t in special}
        for content, number in self.special.items():
            self.texts[number] = content.encode()
        longest_first = sorted(self.special, key=len, reverse=True)
        self.special_at = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if special else None
        self.pieces = regex.compile(PATTERN)
        self.latin_pieces = re.compile(LATIN_PATTERN)
        self.borders: dict[int, bool] = {}
        self.piece_cache: dict[str, bytes] = {}
        self.word_cache: dict[str, bytes] = {}

    @cached_property
    def automaton(self) -> ahocorasick.Automaton:
        made = ahocorasick.Automaton()
        for name, i in self._age.items():
            made.add_word(name, (i, len(name)))
        made.make_automaton()
        return made

    def border_holds(self, left: int, right: int) -> bool:
        """Whether no merge ever crosses the border between two neighbouring tokens.

        Undoes the merges of both, the youngest first. The two tokens at the border
        stood there until the merge just undone, so a merge of the two that is older
        would have been taken. Of equal merges the left one comes first.
        """
        bound = len(self.parts)
        while self.merged.get((left, right), bound) >= bound:
            if left < BYTES and right < BYTES:
                return True
            if left > right:
                bound, left = left, self.parts[left][1]
            else:
                bound, right = right + 1, self.parts[right][0]
        return False

    def last_tokens(self, piece: str) -> list[int]:
        """For every prefix of a piece, given as one character per byte, its last token."""
        last, known = [-1] * len(piece), self.borders
        for at, (token, size) in self.automaton.iter(piece):
            if last[at] < 0:
                if size <= at:
                    pair = last[at - size] << 32 | token
                    if pair not in known:
                        if len(known) >= CACHED:
                            known.clear()
                        known[pair] = self.border_holds(last[at - size], token)
                    if not known[pair]:
                        continue
                last[at] = token
        return last

    def encode_piece(self, piece: str) -> bytes:
        """Ids of one piece of the pattern, as little-endian unsigned 32-bit integers."""
        found = self.piece_cache.get(piece)
        if found is None:
            raw = piece if piece.isascii() else piece.encode().decode("latin-1")
            last, at, back = self.last_tokens(raw), len(raw) - 1, []
            while at >= 0:
                back.append(self.packed[last[at]])
                at -= self.sizes[last[at]]
            found = b"".join(reversed(back))
            if len(piece) <= CACHED_CHARS:
                if len(self.piece_cache) >= CACHED:
                    self.piece_cache.clear()
                self.piece_cache[piece] = found
        return found

    def _ordinary(self, text: str) -> bytes:
        words = _BEFORE_WORD.split(text) if _NO_WORD_AFTER.search(text) else text.split(" ")
        out = list(map(self.word_cache.get, words))
        out[0] = None  # it has no space before it
        if None in out:
            for i, known in enumerate(out):
                if known is None:
                    word = words[i]
                    cut = self.latin_pieces if word and max(word) <= "ÿ" else self.pieces
                    found = b"".join(map(self.encode_piece, cut.findall(" " + word if i else word)))
                    if i and len(word) <= CACHED_CHARS:
                        if len(self.word_cache) >= CACHED:
                            self.word_cache.clear()
                        self.word_cache[word] = found
                    out[i] = found
        return b"".join(out)

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text, as little-endian unsigned 32-bit integers; NULL is empty."""
        if not text:
            return b""
        if self.special_at is None or not self.special_at.search(text):
            return self._ordinary(text)
        return b"".join(
            struct.pack("<I", self.special[part]) if part in self.special else self._ordinary(part)
            for part in self.special_at.split(text) if part
        )

    def decode(self, ids: bytes) -> str:
        numbers = np.frombuffer(ids, "<u4").tolist()
        return b"".join([self.texts[n] for n in numbers]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def bpe(spec: str) -> Bpe:
    """One encoder per Python worker, kept between tasks."""
    return Bpe(spec)


def read_spec(path: str) -> str:
    """The text of a vocabulary file, which goes to the tasks with their function: a few
    megabytes, whatever the data."""
    with open(path, encoding="utf-8") as file:
        spec = file.read()
    if len(spec) > 64 << 20:
        raise ValueError(f"{path} is too large for a vocabulary")
    return spec


def encoded(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """Encodes and decodes every whole text; one row per document, in any order.

    Returns doc_id, n_tokens, ids_sha256, decoded_sha256 and, with ``with_ids``, ids
    (array of int) and decoded. NULL and empty texts have no ids; a NULL or repeated
    doc_id is handed on. Only doc_id and text are read, so other columns may have any
    name. An empty table gives an empty result.
    """
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(path))

    def rows(batches: Iterator[list[list]]) -> Iterator[tuple]:
        coder = bpe(spec.value)
        for doc_ids, texts in batches:
            for doc_id, text in zip(doc_ids, texts):
                ids = coder.encode(text)
                decoded = coder.decode(ids)
                row = (
                    doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(),
                    hashlib.sha256(decoded.encode()).hexdigest(),
                )
                yield (*row, np.frombuffer(ids, "<u4").tolist(), decoded) if with_ids else row

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    if with_ids:
        schema += ", ids array<int>, decoded string"
    return map_rows(docs.select("doc_id", "text"), schema, rows)

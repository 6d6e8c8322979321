"""Hierarchical packing of token sequences into windows of several context sizes.

Each task packs the documents it reads, so nothing is shuffled. Documents longer than
the longest window give whole windows first. The rest of every document waits in a
pool and is routed to the tier of the smallest window that holds it. Tiers are packed
from the longest down: a window opens with the longest document left, its gap takes
the longest shorter ones that fit, and a gap that none fits is closed by the head of
the shortest one left. The last documents of a task fill windows of descending powers
of two, so no window is padded.

Windows of one size and about the same attention cost (the sum of squared piece
lengths) form step groups of equally many tokens.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame

from solvenza.llm.common import map_rows
from solvenza.llm.tokens import PATTERN, bpe, byte_letters, read_spec

TIERS = (256, 512, 1024, 2048)
END_OF_TEXT = 1         # id after every document
POOL = 4096             # documents whose rest waits in a task
STEP_TOKENS = 16_384    # tokens of a step group

# The library's time may grow with the square of longer runs of one kind.
LONG_RUN = 1000
_LONG_BLANK = re.compile(rf"\s{{{LONG_RUN}}}")

SCHEMA = (
    "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
    "sequence_id bigint, offset bigint, sequence_tokens bigint, step_id bigint"
)


@lru_cache(maxsize=2)
def library(spec: str) -> tiktoken.Encoding | None:
    """The tokenizer library under the same vocabulary, if its ids follow the merges. Made
    from the file alone: the operator of ``tokens`` is built only where it is needed."""
    loaded = json.loads(spec)
    vocabulary, special = loaded["model"]["vocab"], {t["content"]: t["id"] for t in loaded.get("added_tokens") or []}
    letters = byte_letters()
    to_byte = {letter: b for b, letter in enumerate(letters)}
    names = [m.replace(" ", "") if isinstance(m, str) else "".join(m) for m in loaded["model"]["merges"]]
    merged = [vocabulary[n] for n in names]
    if merged != sorted(merged):
        return None
    ranks = {bytes(map(to_byte.__getitem__, n)): vocabulary[n] for n in (*letters, *names)}
    return tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


def _long_run(text: str) -> bool:
    """Whether a text has a long run without white space, or of it."""
    lengths = list(map(len, text.split()))
    if lengths and max(lengths) >= LONG_RUN:
        return True
    between = len(text) - sum(lengths) - len(lengths)
    return between >= LONG_RUN - 2 and bool(_LONG_BLANK.search(text))


def token_ids(text: str | None, spec: str) -> bytes:
    """Ids of a whole text as little-endian unsigned 32-bit integers, by the library
    where its time is linear, by the operator of ``tokens`` for the rest."""
    if not text:
        return b""
    fast = library(spec)
    if fast is None or _long_run(text):
        return bpe(spec).encode(text)
    return fast.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False).tobytes()


class Piece(NamedTuple):
    length: int
    serial: int     # order of arrival, for ties
    doc: tuple      # doc_id and number of its tokens
    start: int
    ids: bytes

    def cut(self, at: int, serial: int) -> tuple["Piece", "Piece"]:
        head = self._replace(length=at, ids=self.ids[: 4 * at])
        return head, Piece(self.length - at, serial, self.doc, self.start + at, self.ids[4 * at:])


class Packer:
    """Packs the documents of one task; ``partition`` makes its numbers unique."""

    def __init__(self, partition: int, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS,
                 pool: int = POOL, with_ids: bool = False):
        if any(t & (t - 1) for t in tiers) or sorted(set(tiers)) != list(tiers):
            raise ValueError("tiers are ascending powers of two")
        self.tiers, self.step_tokens, self.limit, self.with_ids = tiers, step_tokens, pool, with_ids
        self.first = partition << 32
        self.serial = self.sequences = self.steps = 0
        self.pool: list[Piece] = []
        self.done: dict[int, list[list[Piece]]] = {}

    def add(self, doc_id: object, ids: bytes) -> Iterator[tuple]:
        tokens, longest = len(ids) // 4, self.tiers[-1]
        doc, whole = (doc_id, tokens), tokens - tokens % longest
        for start in range(0, whole, longest):
            self._close([Piece(longest, self._next(), doc, start, ids[4 * start: 4 * (start + longest)])], longest)
        if tokens > whole:
            insort(self.pool, Piece(tokens - whole, self._next(), doc, whole, ids[4 * whole:]))
        if len(self.pool) >= self.limit or sum(map(len, self.done.values())) >= self.limit:
            self._fill()
            yield from self._steps(last=False)

    def finish(self) -> Iterator[tuple]:
        self._fill()
        left = self.pool[::-1]
        total = sum(p.length for p in left)
        for size in (1 << bit for bit in reversed(range(total.bit_length()))):
            if total & size:
                window, room = [], size
                while room:
                    piece = left.pop(0)
                    if piece.length > room:
                        piece, rest = piece.cut(room, self._next())
                        left.insert(0, rest)
                    window.append(piece)
                    room -= piece.length
                self._close(window, size)
        yield from self._steps(last=True)

    def _next(self) -> int:
        self.serial += 1
        return self.serial

    def _fill(self) -> None:
        """Full windows out of the pool; what can't fill one more stays there."""
        pool = self.pool
        while pool:
            window = [pool.pop()]
            size = next(t for t in self.tiers if t >= window[0].length)
            room = size - window[0].length
            while room and pool:
                at = bisect_right(pool, room, key=lambda p: p.length)
                if at:
                    piece = pool.pop(at - 1)
                else:
                    piece, rest = pool.pop(0).cut(room, self._next())
                    insort(pool, rest)
                window.append(piece)
                room -= piece.length
            if room:
                self.pool = sorted(window)
                return
            self._close(window, size)

    def _close(self, window: list[Piece], size: int) -> None:
        self.done.setdefault(size, []).append(window)

    def _steps(self, last: bool) -> Iterator[tuple]:
        for size, windows in self.done.items():
            windows.sort(key=lambda w: sum(p.length ** 2 for p in w))
            group = max(1, self.step_tokens // size)
            whole = len(windows) if last else len(windows) - len(windows) % group
            for at in range(0, whole, group):
                for window in windows[at:at + group]:
                    yield from self._rows(window, size, self.first + self.steps)
                self.steps += 1
            self.done[size] = windows[whole:]

    def _rows(self, window: list[Piece], size: int, step: int) -> Iterator[tuple]:
        offset, sequence = 0, self.first + self.sequences
        self.sequences += 1
        for p in window:
            row = (
                p.doc[0], p.start, p.length, zlib.crc32(p.ids), p.doc[1], sequence, offset, size, step,
            )
            yield (*row, p.ids) if self.with_ids else row
            offset += p.length


def packed(
    docs: DataFrame, path: str, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS,
    with_ids: bool = False,
) -> DataFrame:
    """Packs the tokens of all documents; one row per piece of a document in a window.

    ``ids_crc32`` is over the ids as little-endian unsigned 32-bit integers, which
    ``with_ids`` adds as binary. Each document ends with id 1, so NULL and empty texts
    have one token. A document may be cut anywhere; pieces of a long one are in several
    windows. A NULL or repeated doc_id is handed on: start and length then say which
    pieces belong together only within a row's text. Only doc_id and text are read. An
    empty table gives an empty result. Window and step numbers hold the partition, so a
    task that runs again gives the same rows.
    """
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(path))
    end = END_OF_TEXT.to_bytes(4, "little")

    def rows(batches: Iterator[list[list]]) -> Iterator[tuple]:
        packer = Packer(TaskContext.get().partitionId(), tiers, step_tokens, with_ids=with_ids)
        for doc_ids, texts in batches:
            for doc_id, text in zip(doc_ids, texts):
                yield from packer.add(doc_id, token_ids(text, spec.value) + end)
        yield from packer.finish()

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, {SCHEMA}" + (", ids binary" if with_ids else "")
    return map_rows(docs.select("doc_id", "text"), schema, rows)

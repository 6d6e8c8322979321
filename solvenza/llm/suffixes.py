"""Exact repeated passages by suffix order and longest previous factors, in Spark.

A window is ``length`` bytes of a text. Its anchor is the leftmost smallest hash of the
shorter strings inside, so equal windows have equal anchors at the same place, and
neighbouring windows mostly share one. A stretch is a run of windows with one anchor;
there is one per about 150 bytes. Stretches are all that is shuffled:

1. Stretches whose anchor occurs once hold no repeat; a table of bits tells most of them.
2. Equal stretches become one; if there were several, every window of theirs repeats.
3. The bytes of one of each are dealt by anchor. Each task sorts the windows of its
   anchors in suffix order, by prefix doubling through ``length`` bytes, and finds the
   nearest earlier positions before and after each window in that order. The longer
   common prefix with one of the two is the window's longest previous factor; where it
   reaches ``length`` the window is a copy, and the position found is its source.
4. An anchor with more bytes than a task should hold is not dealt: its windows are
   hashed, and Spark counts equal ones. What an anchor holds is summed up before.

Every later copy of a window is removed, or every copy, and what remains is joined.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from solvenza.llm.common import bit_table, has_bit, map_rows, maybe_repeated, text_key, unused, written

LENGTH = 400
ANCHOR_BITS = 1 << 27        # of the table of anchors that occur twice
TASK_BYTES = 1 << 20        # bytes of an anchor's stretches that are sorted in a task
SORT_BYTES = 1 << 19        # bytes sorted at a time
BLOCK = 1 << 16             # windows of a text hashed at a time
RANGES = "array<struct<a: int, b: int>>"


# --- anchors --------------------------------------------------------------------

class Rolling:
    """Hashes of all strings of one size in a text: polynomials over random byte values,
    modulo 2**64, from one running sum."""

    def __init__(self, seed: int):
        random = np.random.default_rng(seed)
        self.values = random.integers(0, 1 << 63, 256, np.uint64) << np.uint64(1) | np.uint64(1)
        base = int(random.integers(0, 1 << 61)) * 8 + 5
        self.up, self.down = np.uint64(base), np.uint64(pow(base, -1, 1 << 64))
        self.powers = self._powers(1 << 12)

    def _powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        steps = [np.full(n, x) for x in (self.up, self.down)]
        for s in steps:
            s[0] = 1
        return tuple(np.multiply.accumulate(s) for s in steps)

    def sums(self, data: np.ndarray) -> np.ndarray:
        if len(data) >= len(self.powers[0]):
            self.powers = self._powers(2 * len(data))
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * self.powers[0][: len(data)], out=out[1:])
        return out

    def spans(self, sums: np.ndarray, starts: np.ndarray | slice, ends: np.ndarray | slice) -> np.ndarray:
        """Hash of each span; equal content has an equal hash wherever it starts."""
        down = self.powers[1]
        at = down[starts] if isinstance(starts, np.ndarray) else down[: len(sums)][starts]
        return mixed((sums[ends] - sums[starts]) * at)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(32)


@lru_cache(maxsize=4)
def rolling(seed: int) -> Rolling:
    return Rolling(seed)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` neighbours, from running minima within blocks of ``w``."""
    n = len(x)
    blocks = -(-n // w)
    full = np.full(blocks * w, np.iinfo(np.uint64).max, np.uint64)
    full[:n] = x
    full = full.reshape(blocks, w)
    ahead = np.minimum.accumulate(full, axis=1).ravel()
    back = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1: n])


def stretches(data: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Anchor, content hash, first window and number of windows of each stretch."""
    k, found = max(4, length // 4), []
    for base in range(0, len(data) - length + 1, BLOCK):
        part = data[base: base + BLOCK + length - 1]
        inner, outer = rolling(1), rolling(2)
        sums = inner.sums(part)
        hashes = inner.spans(sums, slice(0, len(part) - k + 1), slice(k, None))
        anchors = sliding_min(hashes, length - k + 1)
        # The leftmost smallest hash moves when a smaller one comes in or it goes out.
        new = (anchors[1:] != anchors[:-1]) | (hashes[: len(anchors) - 1] == anchors[:-1])
        starts = np.flatnonzero(np.concatenate([[True], new]))
        counts = np.diff(np.append(starts, len(anchors)))
        content = outer.spans(outer.sums(part), starts, starts + counts + length - 1)
        found.append((anchors[starts], content, starts + base, counts))
    return tuple(np.concatenate(c) for c in zip(*found)) if found else ()


def all_stretches(docs: DataFrame, length: int) -> DataFrame:
    """key, doc_id, anchor, content, start, windows of all stretches of all texts."""
    return _of_texts(docs, length, lambda data, anchor, content, start, windows: None)


def _of_texts(docs: DataFrame, length: int, chosen: Callable) -> DataFrame:
    """Those stretches of all texts that ``chosen`` marks, which gets a text's bytes and
    what ``stretches`` returns; None is all of them."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select(text_key().alias("key"), "doc_id", F.encode("text", "utf-8").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            taken, parts = [], []
            for i, text in enumerate(batch.column(2)):
                if text.is_valid and len(data := np.frombuffer(text.as_buffer(), np.uint8)) >= length:
                    found = stretches(data, length)
                    mask = chosen(data, *found)
                    parts.append(found if mask is None else tuple(c[mask] for c in found))
                    taken.append(np.full(len(parts[-1][0]), i))
            if parts:
                rows = pa.array(np.concatenate(taken))
                anchor, content, start, windows = (np.concatenate(c) for c in zip(*parts))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(rows), batch.column(1).take(rows),
                    pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64)),
                    pa.array(start.astype(np.int32)), pa.array(windows.astype(np.int32)),
                ], names=["key", "doc_id", "anchor", "content", "start", "windows"])

    return texts.mapInArrow(
        run, f"key bigint, doc_id {kind}, anchor bigint, content bigint, start int, windows int"
    )


_SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))


def in_long_chains(
    data: np.ndarray, start: np.ndarray, windows: np.ndarray, some: np.ndarray, length: int, least_words: int
) -> np.ndarray:
    """Which of ``some`` stretches may lie in a span of ``least_words`` words, if no window
    outside of them repeats: the bytes they cover are joined as spans are, and the words in
    a span are at most those in the bytes that hold it."""
    out, at = np.zeros(len(start), bool), np.flatnonzero(some)
    if not len(at):
        return out
    first, end = start[at], start[at] + windows[at] + length - 1
    cuts = np.flatnonzero(np.concatenate([[True], first[1:] > end[:-1]]))
    space = _SPACE[data]
    begins = np.concatenate([[0], np.cumsum(~space & np.concatenate([[True], space[:-1]]))])
    last = end[np.append(cuts[1:], len(at)) - 1]
    words = begins[last] - begins[first[cuts]] + 1      # the first one may have begun before
    out[at] = np.repeat(words >= least_words, np.diff(np.append(cuts, len(at))))
    return out


def _shared_in_chains(docs: DataFrame, length: int, least_words: int) -> DataFrame:
    """The stretches whose anchor may occur more than once, of those anchors that any span
    of ``least_words`` words may have. Texts are read once for each of three tables of bits
    and rows; no table of all stretches is written, and of repeats too short to be cut
    only those are shuffled that a longer one may come from."""
    anchors = all_stretches(docs, length).select("anchor")
    twice = anchors.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    context = docs.sparkSession.sparkContext
    repeated = context.broadcast(bytes(bit_table(twice, "anchor", ANCHOR_BITS)))

    def chained(data, anchor, content, start, windows):
        some = has_bit(anchor, repeated.value)
        return in_long_chains(data, start, windows, some, length, least_words)

    long = _of_texts(docs, length, chained).select("anchor")
    wanted = context.broadcast(bytes(bit_table(long, "anchor", ANCHOR_BITS)))

    def partners(data, anchor, content, start, windows):
        return has_bit(anchor, repeated.value) & has_bit(anchor, wanted.value)

    return _of_texts(docs, length, partners)


# --- suffix order ---------------------------------------------------------------

def _ranked(keys: np.ndarray) -> np.ndarray:
    order = np.argsort(keys)
    ordered = keys[order]
    ranks = np.empty(len(keys), np.uint64)
    ranks[order] = np.cumsum(np.concatenate([[False], ordered[1:] != ordered[:-1]]))
    return ranks


def rank_levels(data: np.ndarray, length: int) -> list[tuple[int, np.ndarray]]:
    """(size, ranks) for sizes 1, 2, 4, ... and ``length``: positions of equal ranks have
    equal ``size`` bytes, and greater ranks greater ones. The last ``length`` positions
    have no meaning."""
    levels, size = [(1, data.astype(np.uint32))], 1
    while size < length:
        step = min(size, length - size)
        before = levels[-1][1].astype(np.uint64)
        beside = np.concatenate([before[step:], np.zeros(step, np.uint64)])
        joined = before << np.uint64(32) | beside
        size += step
        # Two and four bytes are numbers themselves.
        short = size in (2, 4)
        shift, low = np.uint64(8 * step), np.uint64(0xFFFFFFFF)
        levels.append((size, ((joined >> np.uint64(32)) << shift | joined & low if short else _ranked(joined)).astype(np.uint32)))
    return levels


def window_ranks(data: np.ndarray, length: int) -> np.ndarray:
    """Rank of the ``length`` bytes from each position, equal for equal bytes, in
    suffix order."""
    return rank_levels(data, length)[-1][1]


def nearest_smaller(x: np.ndarray) -> np.ndarray:
    """Place of the nearest smaller number before each one, -1 where there is none. Every
    round jumps from a place that is too large to the one that it points to itself: all
    between them are larger still."""
    found = np.arange(-1, len(x) - 1)
    todo = np.arange(1, len(x))
    while True:
        todo = todo[found[todo] >= 0]
        todo = todo[x[found[todo]] > x[todo]]
        if not len(todo):
            return found
        found[todo] = found[found[todo]]


def common_prefix(levels: list[tuple[int, np.ndarray]], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the strings at positions a and b, at most the size of
    the last level."""
    length, whole = levels[-1]
    at = np.zeros(len(a), np.int64)
    last = len(whole) - 1
    for size, ranks in reversed(levels[:-1]):
        x, y = a + at, b + at
        fits = (at + size <= length) & (x <= last) & (y <= last)
        same = ranks[np.minimum(x, last)] == ranks[np.minimum(y, last)]
        at += np.where(fits & same, size, 0)
    at[whole[a] == whole[b]] = length
    return at


def longest_previous(levels: list[tuple[int, np.ndarray]], at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of the ascending positions ``at`` the longest previous factor, through the
    last level's size, and the index of an earlier position that has it, or -1."""
    order = np.argsort(levels[-1][1][at], kind="stable")    # suffix order, ties by position
    turned = len(order) - 1 - nearest_smaller(order[::-1])[::-1]
    sides = []
    for near in (nearest_smaller(order), np.where(turned < len(order), turned, -1)):
        source = np.full(len(at), -1)
        source[order] = np.where(near >= 0, order[near], -1)
        reach = common_prefix(levels, at, at[source])
        sides.append((np.where(source >= 0, reach, 0), source))
    (a, i), (b, j) = sides
    return np.maximum(a, b), np.where(a >= b, i, j)


def repeats(slices: list[bytes], windows: list[int], length: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each slice, which of its windows occur anywhere else in the slices, and which
    occur earlier. Slices come in order of position."""
    data = np.frombuffer(b"".join(slices), np.uint8)
    begin = np.concatenate([[0], np.cumsum([len(s) for s in slices])[:-1]])
    at = np.concatenate([np.arange(b, b + w) for b, w in zip(begin, windows)])
    factors, source = longest_previous(rank_levels(data, length), at)
    earlier = factors >= length
    anywhere = earlier.copy()
    anywhere[source[earlier]] = True    # the first of equal windows is the second one's source
    ends = np.cumsum(windows)[:-1]
    return list(zip(np.split(anywhere, ends), np.split(earlier, ends)))


def runs(mask: np.ndarray) -> list[tuple[int, int]]:
    """(first, end) of each run of True."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
    return [(int(a), int(b)) for a, b in edges.reshape(-1, 2)]


def _sorted_groups(length: int, sort_bytes: int):
    """Rows (anchor, content, doc_id, key, start, windows, bytes), sorted by anchor and
    content, to (anchor, content, anywhere, earlier)."""
    def judge(rows: list[tuple]) -> Iterator[tuple]:
        rows.sort(key=lambda r: (r[2] is None, r[2] if r[2] is not None else 0, r[3], r[4]))
        found = repeats([r[6] for r in rows], [r[5] for r in rows], length)
        for r, (anywhere, earlier) in zip(rows, found):
            if anywhere.any():
                yield r[0], r[1], runs(anywhere), runs(earlier)

    def run(batches: Iterator[list[list]]) -> Iterator[tuple]:
        held, held_bytes = [], 0
        for batch in batches:
            for row in zip(*batch):
                if held and held[-1][:2] == row[:2]:
                    continue    # a repeated row of documents
                if held_bytes >= sort_bytes and held[-1][0] != row[0]:
                    yield from judge(held)
                    held, held_bytes = [], 0
                held.append(row)
                held_bytes += len(row[6])
        if held:
            yield from judge(held)

    return run


# --- counting crowded anchors ------------------------------------------------------

def _hashed_windows(slices: DataFrame, length: int) -> DataFrame:
    """(anchor, content, at, w1, w2): two hashes of every window of the slices."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data = np.frombuffer(batch.column(2)[i].as_buffer(), np.uint8)
                for base in range(0, len(data) - length + 1, BLOCK):
                    part = data[base: base + BLOCK + length - 1]
                    n = len(part) - length + 1
                    hashes = [
                        pa.array(r.spans(r.sums(part), slice(0, n), slice(length, None)).view(np.int64))
                        for r in (rolling(3), rolling(4))
                    ]
                    keys = [batch.column(c).take(pa.array(np.full(n, i))) for c in (0, 1)]
                    at = pa.array(np.arange(base, base + n, dtype=np.int32))
                    yield pa.RecordBatch.from_arrays([*keys, at, *hashes], names=["anchor", "content", "at", "w1", "w2"])

    return slices.select("anchor", "content", "bytes").mapInArrow(
        run, "anchor bigint, content bigint, at int, w1 bigint, w2 bigint"
    )


def _counted(crowded: DataFrame, length: int) -> DataFrame:
    """The same as the sorted groups give, for anchors that are too many for a task."""
    place = crowded.select("anchor", "content", F.struct(
        F.col("doc_id").isNull().alias("none"), "doc_id", "key", "start").alias("first"))
    windows = written(_hashed_windows(crowded, length).join(place, ["anchor", "content"]).select(
        "anchor", "content", "at", "w1", "w2", F.struct("first", "at").alias("position")
    ), "suffix-windows")
    same = windows.groupBy("anchor", "w1", "w2").agg(
        F.count(F.lit(1)).alias("n"), F.min("position").alias("least")
    )
    same = written(same.filter("n > 1"), "suffix-window-counts")
    hits = windows.join(same, ["anchor", "w1", "w2"])
    found = hits.groupBy("anchor", "content").agg(
        F.sort_array(F.collect_list("at")).alias("anywhere"),
        F.sort_array(F.collect_list(F.when(F.col("position") != F.col("least"), F.col("at")))).alias("earlier"),
    )

    def rows(batches: Iterator[list[list]]) -> Iterator[tuple]:
        for anchors, contents, *lists in batches:
            for anchor, content, *found in zip(anchors, contents, *lists):
                yield (anchor, content, *map(_runs_of, found))

    return map_rows(found, f"anchor bigint, content bigint, anywhere {RANGES}, earlier {RANGES}", rows)


def _runs_of(places: list[int]) -> list[tuple[int, int]]:
    x = np.array(places, np.int64)
    cuts = np.flatnonzero(np.diff(x) > 1) + 1
    return [(int(r[0]), int(r[-1]) + 1) for r in np.split(x, cuts) if len(r)]


# --- operator ---------------------------------------------------------------------

def _slices(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of the wanted stretches, with their places."""
    pieces = F.collect_list(F.struct("anchor", "content", "start", "windows"))
    wanted = wanted.groupBy("_key").agg(pieces.alias("w"))
    texts = docs.select(text_key().alias("key"), "doc_id", F.encode("text", "utf-8").alias("t"))
    texts = texts.join(wanted, F.col("key") == F.col("_key")).select("key", "doc_id", "t", "w")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[list[list]]) -> Iterator[tuple]:
        for batch in batches:
            for key, doc_id, text, pieces in zip(*batch):
                for p in pieces:
                    a, n = p["start"], p["windows"]
                    yield p["anchor"], p["content"], doc_id, key, a, n, text[a: a + n + length - 1]

    schema = f"anchor bigint, content bigint, doc_id {kind}, key bigint, start int, windows int, bytes binary"
    return map_rows(texts, schema, cut)


def repeated_windows(
    docs: DataFrame, length: int = LENGTH, task_bytes: int = TASK_BYTES, sort_bytes: int = SORT_BYTES,
    least_words: int = 0,
) -> DataFrame:
    """(key, anywhere, earlier): by text key, the first windows and ends of runs of
    windows that occur anywhere else, and that occur earlier by doc_id, key and start; all
    of them, or all that spans of ``least_words`` words consist of."""
    if least_words > 1:
        shared = _shared_in_chains(docs, length, least_words)
    else:
        shared = maybe_repeated(written(all_stretches(docs, length), "suffix-stretches"), "anchor", ANCHOR_BITS)
    # Both sides of the joins by anchor are written tables, so that the stretches of a
    # passage in very many texts are split.
    shared = written(shared, "suffix-shared")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "start")
    distinct = shared.groupBy("anchor", "content", "windows").agg(
        F.count(F.lit(1)).alias("n"), F.min(order).alias("first")
    )
    distinct = written(distinct, "suffix-distinct")
    size = F.sum((F.col("windows") + (length - 1)).cast("long"))
    several = distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("c"), size.alias("bytes"))
    several = written(several.filter("c > 1").select("anchor", (F.col("bytes") > task_bytes).alias("crowded")), "suffix-several")
    wanted = distinct.join(several, "anchor").select(
        F.col("first.key").alias("_key"), "anchor", "content", "first.start", "windows", "crowded")
    dealt = _slices(docs, wanted.filter("NOT crowded"), length).repartition("anchor")
    found = written(map_rows(
        dealt.sortWithinPartitions("anchor", "content"),
        f"anchor bigint, content bigint, anywhere {RANGES}, earlier {RANGES}", _sorted_groups(length, sort_bytes),
    ), "suffix-judged")
    if not several.filter("crowded").isEmpty():
        many = _slices(docs, wanted.filter("crowded"), length).dropDuplicates(["anchor", "content"])
        found = found.unionByName(_counted(written(many, "suffix-crowded"), length))
    known = distinct.filter("n > 1").join(found, ["anchor", "content"], "full").select(
        "anchor", "content", F.coalesce("n", F.lit(1)).alias("n"), "first", "anywhere", "earlier"
    )
    known = written(known, "suffix-known")
    # Of several equal stretches all windows repeat, and all but the first one's earlier.
    whole = F.array(F.struct(F.lit(0).alias("a"), F.col("windows").alias("b")))
    none = F.array().cast(RANGES)
    is_first = (F.col("n") == 1) | (order == F.col("first"))
    moved = lambda c: F.transform(c, lambda r: F.struct(
        (r["a"] + F.col("start")).alias("a"), (r["b"] + F.col("start")).alias("b")))
    hits = shared.join(known, ["anchor", "content"]).select(
        "key",
        moved(F.when(F.col("n") > 1, whole).otherwise(F.coalesce("anywhere", none))).alias("anywhere"),
        moved(F.when(is_first, F.coalesce("earlier", none)).otherwise(whole)).alias("earlier"),
    )
    return hits.groupBy("key").agg(
        F.flatten(F.collect_set("anywhere")).alias("anywhere"), F.flatten(F.collect_set("earlier")).alias("earlier")
    )


def _spans(windows: list[dict] | None, length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by the windows of the ranges."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((r["a"], r["b"] + length - 1) for r in windows or []):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def kept_bytes(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for s in spans for x in s), len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))


def _with_windows(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The columns of ``docs`` and, last, the windows found in each text."""
    own = unused(docs, "_own")
    key, windows = unused(docs, f"{own}_key"), unused(docs, f"{own}_windows")
    found = found.select(F.col("key").alias(key), F.col("w").alias(windows))
    joined = docs.withColumn(own, text_key()).join(found, F.col(own) == F.col(key), "left")
    return joined.select(*docs.columns, windows)


def deduplicated(
    docs: DataFrame, length: int = LENGTH, keep: str = "none", task_bytes: int = TASK_BYTES,
    sort_bytes: int = SORT_BYTES,
) -> DataFrame:
    """All rows and columns of ``docs`` with ``kept`` (binary) and ``removed`` spans.

    Removes each byte of a window of ``length`` bytes that occurs anywhere else, in any
    text, overlaps included (``keep="none"``), or that occurs earlier by doc_id, text key
    and place (``keep="first"``). All is judged on the input; matches never cross texts.
    NULL and empty texts keep nothing and lose nothing. Rows equal in doc_id and text are
    copies of each other: both lose all with "none"; with "first" they have one place and
    so equal results. NULL doc_ids come last. An empty table gives an empty result.
    Columns named like the two results are replaced, others pass through.
    """
    docs = docs.select(*[c for c in docs.columns if c.lower() not in ("kept", "removed")])
    mine = {"none": "anywhere", "first": "earlier"}[keep]
    found = repeated_windows(docs, length, task_bytes, sort_bytes).select("key", F.col(mine).alias("w"))
    place = docs.columns.index("text")

    def rows(batches: Iterator[list[list]]) -> Iterator[tuple]:
        for batch in batches:
            for *row, found in zip(*batch):
                data, spans = (row[place] or "").encode(), _spans(found, length)
                yield (*row, kept_bytes(data, spans), spans)

    span = T.StructType().add("start", "integer").add("end", "integer")
    schema = T.StructType(list(docs.schema)).add("kept", T.BinaryType()).add("removed", T.ArrayType(span))
    return map_rows(_with_windows(docs, found), schema, rows)


def without_repeats(docs: DataFrame, length: int = LENGTH, keep: str = "first", least_words: int = 0) -> DataFrame:
    """The rows and columns of ``docs`` with the repeats cut out of the text, those of at
    least ``least_words`` words, as far as they lie inside. A character of which a byte is
    removed goes whole; NULL texts stay NULL. Columns may have any names."""
    mine = {"none": "anywhere", "first": "earlier"}[keep]
    found = repeated_windows(docs, length, least_words=least_words).select("key", F.col(mine).alias("w"))
    place = docs.columns.index("text")

    def rows(batches: Iterator[list[list]]) -> Iterator[tuple]:
        for batch in batches:
            for *row, found in zip(*batch):
                if found:
                    data = row[place].encode()
                    spans = [(a, b) for a, b in _spans(found, length) if len(data[a:b].split()) >= least_words]
                    row[place] = kept_bytes(data, spans).decode("utf-8", "ignore")
                yield tuple(row)

    return map_rows(_with_windows(docs, found), docs.schema, rows)

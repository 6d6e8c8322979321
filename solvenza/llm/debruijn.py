"""Repeated word sequences by a compacted de Bruijn graph of words, in Spark.

An edge of the graph is a window of ``length`` words, its nodes are the window without
its last and without its first word. Writing out every edge would shuffle each text many
times over, so edges travel in runs:

1. The seed of an edge is the leftmost smallest hash of its ``seed_words`` word strings.
   Neighbouring edges mostly share one; a run is what follows each other with one seed,
   about eight edges, ``length - seed_words + 1`` at most. Equal edges have equal seeds,
   and runs are equal when their seed, their length and 79 more bits of their words are.
2. Runs whose seed occurs once hold no repeated edge and go: a table of bits of a fixed
   size tells most of them without a shuffle. Equal runs become one, with the number of
   copies and the place of the first.
3. Where a seed has several different runs, the edges of one copy of each are written
   out, under a digest of their words. Per edge Spark combines how often it occurs, where
   it occurs first, and whether all runs agree on the edge before and the edge after it:
   the in and out degree. Repeated edges that follow each other without a branch make a
   path, which has one first place for all its edges.
4. Paths are joined back to the runs, and so to every place. Source coordinates verify
   and lengthen them: where a path ends with its run and the next one continues both here
   and at the source, the two are one span, which names the place that it repeats.

Runs, edges and paths are joined as written tables, so that a frequent seed or passage is
split over tasks; what is collected is a run's paths and a text's spans.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from solvenza.llm.common import bit_table, bits_of, map_rows, maybe_in, maybe_repeated, text_key, unused, written
from solvenza.llm.suffixes import mixed, runs as runs_of, sliding_min

LENGTH = 20
SEED_WORDS = 6
BLOCK = 1 << 16             # edges of a text hashed at a time
TEXT_BLOCK = 1 << 18        # bytes of a text split into words at a time
RUN = ["seed", "content", "tag"]   # tag: 15 bits of another hash, then the number of edges
MOST_EDGES = 1 << 16
SEED_BITS = 1 << 27         # of the table of seeds that occur twice
TEXT_BITS = 1 << 24         # of the tables of texts that have something to look up
_BLANK = re.compile(rb"[\x20\x09-\x0D]")
_IS_BLANK = np.isin(np.arange(256), [32, *range(9, 14)])


# --- words ------------------------------------------------------------------------

class Hashes(dict):
    """64-bit hashes of words; holds short ones, at most ``MOST`` of them."""
    MOST, SHORT = 100_000, 48

    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh3_64_intdigest(word)
        if len(word) <= self.SHORT:
            if len(self) >= self.MOST:
                self.clear()
            self[word] = found
        return found


def word_hashes(data: bytes, hashes: Hashes, size: int) -> np.ndarray:
    """A hash for each word, from blocks that end between two words."""
    parts, start = [], 0
    while start < len(data):
        end = start + size
        if end < len(data):
            blank = _BLANK.search(data, end)
            end = blank.start() if blank else len(data)
        words = data[start:end].split()
        parts.append(np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)))
        start = end
    return np.concatenate(parts) if parts else np.empty(0, np.uint64)


class Words:
    """Where the words of a text begin and end."""

    def __init__(self, data: bytes):
        blank = _IS_BLANK[np.frombuffer(data, np.uint8)]
        turns = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]])))
        self.data, self.begins, self.ends = data, turns[::2], turns[1::2]

    def __len__(self) -> int:
        return len(self.begins)

    def joined(self, first: int, end: int) -> bytes:
        """The words from ``first`` to before ``end``, one space between two."""
        parts = []
        for a in range(first, end, BLOCK):
            b = min(a + BLOCK, end)
            parts.append(b" ".join(self.data[self.begins[a]: self.ends[b - 1]].split()))
        return b" ".join(parts)

    def digests(self, first: int, end: int, length: int) -> list[tuple[int, int]]:
        """128 bits, as two signed numbers, of the ``length`` words from each place on."""
        words, out = self.joined(first, end + length - 1).split(b" "), []
        for i in range(end - first):
            found = blake2b(b" ".join(words[i: i + length]), digest_size=16).digest()
            out.append(struct.unpack("<qq", found))
        return out


# --- runs of edges ----------------------------------------------------------------

@lru_cache(maxsize=4)
def _powers(seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    base = int(np.random.default_rng(seed).integers(0, 1 << 61)) * 8 + 5
    steps = [np.full(n, x, np.uint64) for x in (base, pow(base, -1, 1 << 64))]
    for s in steps:
        s[0] = 1
    return tuple(np.multiply.accumulate(s) for s in steps)


def _strings(part: np.ndarray, seed: int, most: int):
    """A function of first words and ends to the hashes of the word strings between."""
    up, down = _powers(seed, most)
    sums = np.zeros(len(part) + 1, np.uint64)
    np.cumsum(part * up[: len(part)], out=sums[1:])
    return lambda first, end: mixed((sums[end] - sums[first]) * down[first])


def edge_runs(hashes: np.ndarray, length: int, seed_words: int, block: int) -> tuple[np.ndarray, ...]:
    """Seed, content hash, first edge and tag of each run of a text."""
    found, most = [], block + length
    for base in range(0, len(hashes) - length + 1, block):
        part = hashes[base: base + block + length - 1]
        first = np.arange(len(part) - seed_words + 1)
        inner = _strings(part, 1, most)(first, first + seed_words)
        seeds = sliding_min(inner, length - seed_words + 1)
        new = (seeds[1:] != seeds[:-1]) | (inner[: len(seeds) - 1] == seeds[:-1])
        starts = np.flatnonzero(np.concatenate([[True], new]))
        counts = np.diff(np.append(starts, len(seeds)))
        content, check = (_strings(part, n, most)(starts, starts + counts + length - 1) for n in (2, 3))
        tag = (check >> np.uint64(49)) * np.uint64(MOST_EDGES) | counts.astype(np.uint64)
        found.append((seeds[starts], content, starts + base, tag))
    return tuple(np.concatenate(c) for c in zip(*found)) if found else ()


def all_runs(docs: DataFrame, length: int, seed_words: int) -> DataFrame:
    """key, doc_id, seed, content, tag, first of all runs of all texts."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    chosen = docs.select(text_key().alias("key"), "doc_id", F.encode("text", "utf-8").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in batches:
            taken, parts = [], []
            for i, text in enumerate(batch.column(2)):
                words = word_hashes(text.as_py(), hashes, TEXT_BLOCK) if text.is_valid else ()
                if len(words) >= length:
                    parts.append(edge_runs(words, length, seed_words, BLOCK))
                    taken.append(np.full(len(parts[-1][0]), i))
            if parts:
                rows = pa.array(np.concatenate(taken))
                seed, content, first, tag = (np.concatenate(c) for c in zip(*parts))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(rows), batch.column(1).take(rows),
                    pa.array(seed.view(np.int64)), pa.array(content.view(np.int64)),
                    pa.array(tag.astype(np.int32)), pa.array(first.astype(np.int32)),
                ], names=["key", "doc_id", *RUN, "first"])

    return chosen.mapInArrow(
        run, f"key bigint, doc_id {kind}, seed bigint, content bigint, tag int, first int"
    )


# --- graph ------------------------------------------------------------------------

def _edges_of(tag: Column | str) -> Column:
    tag = F.col(tag) if isinstance(tag, str) else tag
    return tag.bitwiseAND(F.lit(MOST_EDGES - 1))


def _place(at: Column | str) -> Column:
    """Order of places: by document, NULL last, by text key and by word."""
    at = F.col(at) if isinstance(at, str) else at
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", at.alias("at"))


def _from_sources(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """A row for each edge of the wanted runs, read where the run occurs first."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    asked = written(wanted.groupBy(F.col("place.key").alias("_key")).agg(F.collect_list(F.struct(
        *RUN, F.col("place.at").alias("first"), "copies")).alias("runs")), "graph-asked")
    texts = docs.select(text_key().alias("key"), "doc_id", F.encode("text", "utf-8").alias("t"))
    # Texts that nothing is asked of are not shuffled.
    texts = maybe_in(texts, "key", bit_table(asked, "_key", TEXT_BITS))
    texts = texts.join(asked, F.col("key") == F.col("_key")).select("key", "doc_id", "t", "runs").sortWithinPartitions("key")

    def rows(batches: Iterator[list[list]]) -> Iterator[tuple]:
        last = None
        for batch in batches:
            for key, doc_id, text, asked in zip(*batch):
                if key == last:
                    continue    # a repeated row of documents
                last, words = key, Words(text)
                for r in asked:
                    run, first = (r["seed"], r["content"], r["tag"]), r["first"]
                    edges = words.digests(first, first + (r["tag"] & MOST_EDGES - 1), length)
                    for i, (e1, e2) in enumerate(edges):
                        before = edges[i - 1][0] if i else None
                        after = edges[i + 1][0] if i + 1 < len(edges) else None
                        yield (*run, i, e1, e2, before, after, r["copies"], doc_id, key, first + i)

    return map_rows(
        texts, "seed bigint, content bigint, tag int, at int, e1 bigint, e2 bigint, before bigint, "
        f"after bigint, copies bigint, doc_id {kind}, key bigint, first int", rows)


def _degrees(edges: DataFrame) -> DataFrame:
    """Per repeated edge its first place, and whether one edge comes before and after."""
    one = lambda c: (F.count(c) == F.count(F.lit(1))) & (F.min(c) == F.max(c))
    found = edges.groupBy("seed", "e1", "e2").agg(
        F.sum("copies").alias("n"), F.min(_place("first")).alias("place"),
        F.coalesce(one("before"), F.lit(False)).alias("in_one"),
        F.coalesce(one("after"), F.lit(False)).alias("out_one"),
    )
    return found.filter("n > 1").drop("n")


def _paths(edges: DataFrame, repeated: DataFrame) -> DataFrame:
    """(run, at, n, place): the stretches of a run of repeated edges without a branch."""
    of_run = edges.select(*RUN, "at", "e1", "e2").join(repeated, ["seed", "e1", "e2"])
    found = F.sort_array(F.collect_set(F.struct("at", "in_one", "out_one", "place")))
    of_run = of_run.groupBy(*RUN).agg(found.alias("found"))
    before = lambda i: F.get("found", i - 1)
    goes_on = lambda e, i: (
        (before(i)["at"] == e["at"] - 1) & before(i)["out_one"] & e["in_one"])
    begins = F.transform("found", lambda e, i: F.struct(
        e["at"].alias("at"), F.coalesce(goes_on(e, i), F.lit(False)).alias("on"), e["place"].alias("place")))
    of_run = of_run.select(*RUN, begins.alias("found"))
    heads = F.filter("found", lambda e: ~e["on"])
    of_run = of_run.select(*RUN, "found", heads.alias("heads"))
    # A path has the edges up to the next head.
    upto = lambda i: F.coalesce(F.get("heads", i + 1)["at"], F.lit(MOST_EDGES))
    n = lambda h, i: F.size(F.filter("found", lambda e: (e["at"] >= h["at"]) & (e["at"] < upto(i))))
    paths = F.transform("heads", lambda h, i: F.struct(h["at"].alias("at"), n(h, i).alias("n"), h["place"].alias("place")))
    return of_run.select(*RUN, F.inline(paths))


def repeated_spans(docs: DataFrame, length: int = LENGTH, seed_words: int = SEED_WORDS, bits: int = SEED_BITS) -> DataFrame:
    """(key, spans): per text key the paths that have an earlier place, as (first, n) edges
    here and the place (doc_id, key, at) of the source."""
    every = written(all_runs(docs, length, seed_words), "graph-runs")
    shared = written(maybe_repeated(every, "seed", bits), "graph-shared")
    distinct = written(shared.groupBy(*RUN).agg(
        F.count(F.lit(1)).alias("copies"), F.min(_place("first")).alias("place")), "graph-distinct")
    several = distinct.groupBy("seed").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("seed")
    several = written(several, "graph-several")
    edges = written(_from_sources(docs, distinct.join(several, "seed", "left_semi"), length), "graph-edges")
    # Most edges occur once even there, and need no degree.
    often = edges.groupBy("e1").agg(F.sum("copies").alias("n")).filter("n > 1")
    edges = maybe_in(edges, "e1", bit_table(often, "e1", bits))
    paths = _paths(edges, written(_degrees(edges), "graph-degrees"))
    # A run that has its seed for itself is a path.
    whole = distinct.filter("copies > 1").join(several, "seed", "left_anti").select(
        *RUN, F.lit(0).alias("at"), _edges_of("tag").alias("n"), "place")
    paths = written(paths.unionByName(whole), "graph-paths")
    hits = shared.join(paths, RUN).withColumn("first", F.col("first") + F.col("at"))
    hits = hits.filter(F.col("place") != _place("first"))
    return hits.groupBy("key").agg(F.collect_set(F.struct(
        "first", "n", F.col("place.doc_id").alias("doc_id"), F.col("place.key").alias("key"), F.col("place.at").alias("at"),
    )).alias("spans"))


# --- operator ---------------------------------------------------------------------

def _joined(spans: pa.ListScalar, length: int) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """First words, ends, source documents and first words there of the spans, joined where
    the next path continues both here and at the source."""
    found = spans.values
    first, n, key, at = (found.field(c).to_numpy() for c in ("first", "n", "key", "at"))
    order = np.argsort(first, kind="stable")
    first, n, key, at = first[order], n[order], key[order], at[order]
    apart = (first[1:] != first[:-1] + n[:-1]) | (key[1:] != key[:-1]) | (at[1:] - first[1:] != at[:-1] - first[:-1])
    starts = np.flatnonzero(np.concatenate([[True], apart]))
    last = np.append(starts[1:], len(first)) - 1
    return first[starts], first[last] + n[last] + length - 1, found.field("doc_id").take(pa.array(order[starts])), at[starts]


def deduplicated(
    docs: DataFrame, length: int = LENGTH, seed_words: int = SEED_WORDS, with_spans: bool = True,
    bits: int = SEED_BITS,
) -> DataFrame:
    """All rows and columns of ``docs`` with ``kept``, ``n_words``, ``n_removed``, ``repeats``.

    Words are what stands between spaces, tabs and line ends, unchanged. A word goes if a
    window of ``length`` words that covers it also starts earlier: in a smaller doc_id, or
    earlier in the same document. Windows are judged on the input and never cross texts.
    ``kept`` is the words that stay, one space between two; ``repeats``, left out without
    ``with_spans``, holds the spans (start, end, source, source_start) in words, which may
    overlap by less than ``length``.

    NULL, empty and short texts keep all words they have. Rows equal in doc_id and text
    have one place, so neither repeats the other and their results are equal; rows of one
    doc_id with different texts are ordered by a hash of the text. NULL doc_ids come last.
    An empty table gives an empty result. Other columns pass through, whatever their names;
    columns named like the four results are replaced.
    """
    if not 0 < seed_words <= length <= MOST_EDGES:
        raise ValueError("seed_words must lie between 1 and length")
    results = ["kept", "n_words", "n_removed", "repeats"]
    names = [c for c in docs.columns if c.lower() not in results]
    docs = docs.select(*names)
    own = unused(docs, "_own")
    key, spans = unused(docs, f"{own}_key"), unused(docs, f"{own}_spans")
    found = repeated_spans(docs, length, seed_words, bits)
    found = written(found.select(F.col("key").alias(key), F.col("spans").alias(spans)), "graph-spans")
    # Texts without spans stay where they are, the others meet theirs.
    table = docs.sparkSession.sparkContext.broadcast(bytes(bit_table(found, key, TEXT_BITS)))
    keyed = docs.withColumn(own, text_key())
    joined = maybe_in(keyed, own, table.value).join(found, F.col(own) == F.col(key), "left")
    place, kind = names.index("text"), docs.schema["doc_id"].dataType

    span = T.StructType().add("start", "integer").add("end", "integer").add("source", kind).add("source_start", "integer")
    schema = T.StructType(list(docs.schema)).add("kept", "string").add("n_words", "long").add("n_removed", "long")
    schema = schema.add("repeats", T.ArrayType(span)) if with_spans else schema
    added = list(to_arrow_schema(schema))[len(names):]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(batch.column(place).cast(pa.binary()), batch.column(len(names))):
                out.append(_cut(text.as_py() or b"", spans, length, with_spans))
            columns = zip(*out) if out else [[]] * len(added)
            arrays = [pa.array(c, pa.binary() if f.type == pa.string() else f.type) for c, f in zip(columns, added)]
            arrays[0] = arrays[0].cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(names)], *arrays], names=[*names, *[f.name for f in added]])

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = pa.list_(pa.int32())
        for batch in batches:
            batch = batch.filter(pa.compute.invert(bits_of(batch.column(len(names)), table.value)))
            yield from cut(iter([batch.set_column(len(names), spans, pa.nulls(batch.num_rows, nothing))]))

    alone = keyed.select(*names, own).mapInArrow(others, schema)
    return joined.select(*names, spans).mapInArrow(cut, schema).unionByName(alone)


def _cut(data: bytes, spans: pa.ListScalar, length: int, with_spans: bool) -> tuple:
    if not spans.is_valid:
        if len(data) <= TEXT_BLOCK:
            words = data.split()
            return (b" ".join(words), len(words), 0, []) if with_spans else (b" ".join(words), len(words), 0)
        words = Words(data)
        kept = words.joined(0, len(words))
        return (kept, len(words), 0, []) if with_spans else (kept, len(words), 0)
    words, (first, end, source, at) = Words(data), _joined(spans, length)
    turns = np.zeros(len(words) + 1, np.int64)
    np.add.at(turns, first, 1)
    np.add.at(turns, end, -1)
    gone = np.cumsum(turns) > 0
    n_removed = int(gone.sum())
    gone[-1] = True
    kept = b" ".join(words.joined(a, b) for a, b in runs_of(~gone))
    if not with_spans:
        return kept, len(words), n_removed
    repeats = [dict(zip(("start", "end", "source", "source_start"), r)) for r in zip(
        first.tolist(), end.tolist(), source.to_pylist(), at.tolist())]
    return kept, len(words), n_removed, repeats

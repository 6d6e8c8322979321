"""SimHash near duplicates by meet-in-the-middle ball hashing.

Fingerprints within 3 bits are found without comparing all pairs. The 64 bits are
cut into blocks; of two fingerprints that differ in up to 3 bits, some block holds one
of them, and without it at most 2 remain. So every fingerprint, for each block left
out, emits itself and all variants at half that radius, one flipped bit: two linked
ones emit a common variant. Variants are shuffled, and colliding fingerprints verified
on all 64 bits. (A ball over the whole fingerprint needs radius 2: 2,081 variants each
instead of 129.)

Fingerprints are made distinct first, so exact copies cost one row. A variant that
very many fingerprints emit is not handled where it meets: they go through a second
round with small blocks, in which no variant can have more than ``FINE_MOST``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from xxhash import xxh64_intdigest

from solvenza.llm.common import map_rows, text_key, unused, written
from solvenza.llm.components import components

SHINGLE = 3
SEED = 42
RADIUS = 3
BLOCKS, FINE_BLOCKS = 3, 8
# Fingerprints under one variant that a task compares in the first round.
MEET_MOST = 8192
# All that can meet in the second: one of 57 variants, times the block left out.
FINE_MOST = 57 << 8
HASHES_AT_ONCE = 1 << 16


def fingerprint(text: str | None) -> int:
    """Majority bits of the hashes of a text's word shingles, as a signed 64-bit integer."""
    words = (text or "").encode().lower().split()  # both know ASCII only
    if not words:
        return 0
    runs = zip(*(words[i:] for i in range(SHINGLE))) if len(words) >= SHINGLE else [words]
    hashes = np.fromiter(map(xxh64_intdigest, map(b" ".join, runs), repeat(SEED)), np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), HASHES_AT_ONCE):
        octets = hashes[at:at + HASHES_AT_ONCE].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, *extra: Column) -> DataFrame:
    """doc_id, fp and ``extra`` columns of every document."""
    chosen = docs.select("doc_id", *extra, "text")
    kept = chosen.schema[:-1]

    def rows(batches: Iterator[list[list]]) -> Iterator[tuple]:
        for *others, texts in batches:
            yield from zip(*others, map(fingerprint, texts))

    return map_rows(chosen, type(chosen.schema)(list(kept)).add("fp", "long"), rows)


def variants(fps: DataFrame, blocks: int) -> DataFrame:
    """(variant, fp): for each block left out, the fingerprint and its one-bit neighbours.

    The bits of the block left out are all set. Variants of different blocks may be
    equal by chance; what meets is verified anyway.
    """
    masks = []
    for b in range(blocks):
        out = sum(1 << bit for bit in range(64 * b // blocks, 64 * (b + 1) // blocks))
        masks += [(out, 0)] + [(out, 1 << bit) for bit in range(64) if not out >> bit & 1]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    pairs = F.array(*[F.struct(F.lit(signed(o)).alias("o"), F.lit(signed(f)).alias("f")) for o, f in masks])
    each = fps.select("fp", F.explode(pairs).alias("m"))
    return each.select(F.col("fp").bitwiseOR(F.col("m.o")).bitwiseXOR(F.col("m.f")).alias("variant"), "fp")


def _close(a: np.ndarray, b: np.ndarray | np.int64) -> np.ndarray:
    # Of a signed number the bits of its absolute value would be counted.
    return np.bitwise_count((a ^ b).view(np.uint64)) <= RADIUS


def _spanning(group: np.ndarray) -> Iterator[tuple[int, int]]:
    """Verified links that connect what all links of the group connect."""
    left = group
    while left.size > 1:
        edge, left = [left[0]], left[1:]
        while edge and left.size:
            at = edge.pop()
            near = _close(left, at)
            if near.any():
                for other in left[near]:
                    yield int(at), int(other)
                edge.extend(left[near])
                left = left[~near]


def _meetings(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of the fingerprints under each variant; (a, NULL) for each of a
    variant with more than ``most``. Rows come sorted by variant and fingerprint; a task
    holds one batch and at most ``most`` rows of the variant before it."""
    empty = np.empty(0, np.int64)
    held_key, held, crowded = None, empty, False

    def links(groups: list[np.ndarray]) -> Iterator[tuple[int, int]]:
        for group in groups:
            yield from _spanning(group)

    def out(a: np.ndarray, b: np.ndarray | None) -> pa.RecordBatch:
        a = pa.array(a, pa.int64())
        return pa.RecordBatch.from_arrays(
            [a, pa.nulls(len(a), pa.int64()) if b is None else pa.array(b, pa.int64())], names=["a", "b"]
        )

    for batch in batches:
        keys = batch.column(0).to_numpy()
        fps = batch.column(1).to_numpy()
        if not len(keys):
            continue
        if held_key is not None and keys[0] == held_key and crowded:
            n = int(np.searchsorted(keys, held_key, "right"))
            yield out(fps[:n], None)
            keys, fps = keys[n:], fps[n:]
            if not len(keys):
                continue
            held_key, held, crowded = None, empty, False
        if len(held):
            keys = np.concatenate([np.full(len(held), held_key), keys])
            fps = np.concatenate([held, fps])
        held_key = keys[-1]
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sizes = np.diff(np.append(starts, len(keys)))
        # The last variant may go on in the next batch.
        last, starts, sizes = starts[-1], starts[:-1], sizes[:-1]
        held, crowded = fps[last:], len(fps) - last > most
        two = starts[sizes == 2]
        near = _close(fps[two], fps[two + 1])
        yield out(fps[two][near], fps[two + 1][near])
        more = [(s, n) for s, n in zip(starts[sizes > 2], sizes[sizes > 2])]
        found = list(links([fps[s:s + n] for s, n in more if n <= most]))
        if found:
            yield out(*map(list, zip(*found)))
        for s, n in more:
            if n > most:
                yield out(fps[s:s + n], None)
        if crowded:
            yield out(held, None)
            held = empty
    found = list(_spanning(held))
    if found:
        yield out(*map(list, zip(*found)))


def links(fps: DataFrame, most: int = MEET_MOST) -> DataFrame:
    """Links (a, b) that connect all fingerprints with a chain of steps of at most 3 bits."""
    def met(of: DataFrame, blocks: int, most: int) -> DataFrame:
        emitted = variants(of, blocks)
        dealt = emitted.repartition("variant").sortWithinPartitions("variant", "fp")
        return dealt.mapInArrow(lambda batches: _meetings(batches, most), "a bigint, b bigint")

    first = written(met(fps, BLOCKS, most).distinct(), "simhash-links")
    crowded = first.filter("b IS NULL").select(F.col("a").alias("fp")).distinct()
    found = first.filter("b IS NOT NULL")
    if crowded.isEmpty():
        return found
    second = met(written(crowded, "simhash-crowded"), FINE_BLOCKS, FINE_MOST)
    return found.unionByName(second)


def near_duplicates(docs: DataFrame, *extra: Column, most: int = MEET_MOST) -> DataFrame:
    """doc_id, fp, root and component_id of every document, with ``extra`` columns.
    ``root`` is the smallest fingerprint of the component.

    Documents link when their fingerprints differ in at most 3 bits; component_id is
    the smallest doc_id that links reach, itself included. NULL, empty and blank texts
    have fingerprint zero and link like any other. A NULL doc_id belongs to the
    component of its fingerprint, but names it only when all others are NULL too; then
    component_id is NULL. Repeated rows stay, each in the same component. Only doc_id,
    text and ``extra`` are read. An empty table gives an empty result.
    """
    marked = written(fingerprints(docs, *extra), "simhash-docs")
    distinct = written(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-fps")
    roots = components(links(distinct.select("fp"), most)).withColumnRenamed("node", "fp")
    rooted = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    class_of = written(rooted.select("fp", "root").join(named, "root"), "simhash-classes")
    return marked.join(class_of, "fp")


def representatives(docs: DataFrame) -> DataFrame:
    """One row of each component, with all columns of ``docs``: that of the smallest
    doc_id, a NULL one last; then the smallest key of id and text. Of rows equal in both
    one stays."""
    found = near_duplicates(docs, text_key().alias("key"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    chosen = found.groupBy("root").agg(F.min(order).alias("first")).select(F.col("first.key").alias("_chosen"))
    key = unused(docs, "_key")
    own = docs.withColumn(key, text_key())
    kept = own.join(written(chosen, "simhash-chosen"), F.col(key) == F.col("_chosen"), "left_semi")
    return kept.dropDuplicates([key]).drop(key)

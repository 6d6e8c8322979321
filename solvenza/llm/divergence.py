"""How far the vocabularies of a language's sources lie apart, exactly, in Spark.

A group is a (lang, source). Its share of a kept term is smoothed by one, so every pair
of groups differs in all terms of the language, nearly all of them at the shares of terms
that neither has. The sum over all terms is taken apart, b being a group's share of a term
it does not have (its zero baseline) and f the divergence of two shares:

    V f(b, b')                                  no term at all
    + sum over the terms of the first   f(p, b') - f(b, b')
    + sum over the terms of the second  f(b, p') - f(b, b')
    + sum over the terms of both        f(p, p') - f(p, b') - f(b, p') + f(b, b')

The second and third line need a group's shares only, and equal shares count once. The
last is a sparse matrix product and is done as one, row by row: a task holds terms with
the groups that have them (the term-major index), takes one group after the other, and
scatters its terms through the index into a dense accumulator with a place per peer. What
leaves the task is an accumulator per group and block of terms, never a posting pair.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from solvenza.llm.common import map_rows, written

SCALE = 1_000_000_000
LEAST_DOCS = 3
TOP_TERMS = 200
HELD_TERMS = 200_000        # distinct terms counted at a time in a task
HELD_BYTES = 16 << 20       # bytes of text counted at a time in a task
TEXT_BLOCK = 1 << 22        # bytes of a text counted at a time
POSTINGS = 1 << 20          # postings of the index that a task holds at a time
PEERS = 1024                # peers, and shares at a time, that meet in a row
SLICES = 16                 # rows that a group's distinct shares are dealt to
EXACT = "decimal(38,0)"

# Bytes of a term keep themselves, A-Z in lower case; all others become a space.
_TERM_BYTES = bytes(
    b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)
)
_BREAK = re.compile(rb"[\x00-\x40\x5B-\x60\x7B-\x7F]")


# --- counts -----------------------------------------------------------------------

def _blocks(data: bytes, size: int) -> Iterator[list[bytes]]:
    """The terms of a text, a block at a time, which ends where a term does."""
    start = 0
    while start < len(data):
        end = start + size
        if end < len(data):
            found = _BREAK.search(data, end)
            end = found.start() if found else len(data)
        yield data[start:end].translate(_TERM_BYTES).split()
        start = end


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, count, docs: occurrences and documents of every term of every
    group, and a row with the empty term for every group.

    Tasks count before anything is shuffled, within a bound of terms and bytes. A long text
    is counted by blocks; its terms are held while it lasts, so that it counts once.
    """
    chosen = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, within = defaultdict(Counter), defaultdict(Counter)
        held, held_terms = 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            for group, found in counts.items():
                yield _counted_batch(group, found, within[group])
            counts.clear(), within.clear()

        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            for *group, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts):
                group, data, seen = tuple(group), text.as_py(), set()
                counts[group][b""] = within[group][b""] = 0
                for terms in _blocks(data, TEXT_BLOCK):
                    found, distinct = counts[group], set(terms)
                    before = len(found)
                    found.update(terms)
                    within[group].update(distinct - seen if seen else distinct)
                    if len(data) > TEXT_BLOCK:
                        seen |= distinct
                    held += min(len(data), TEXT_BLOCK)
                    held_terms += len(found) - before
                    if held > HELD_BYTES or held_terms > HELD_TERMS:
                        yield from flush()
                        held = held_terms = 0
        yield from flush()

    found = chosen.mapInArrow(run, "lang string, source string, term string, count bigint, docs bigint")
    return found.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def _counted_batch(group: tuple[str, str], counts: Counter, within: Counter) -> pa.RecordBatch:
    n = len(counts)
    return pa.RecordBatch.from_arrays([
        *[pa.repeat(name, n) for name in group], pa.array(list(counts), pa.binary()).cast(pa.string()),
        pa.array(list(counts.values()), pa.int64()), pa.array(list(map(within.__getitem__, counts)), pa.int64()),
    ], names=["lang", "source", "term", "count", "docs"])


def _share(count: Column | str, total: str) -> Column:
    """1 + floor(SCALE (count + 1) / (total + V)), in whole numbers."""
    count = F.col(count) if isinstance(count, str) else count
    return F.lit(1) + F.call_function(
        "div", (count + 1).cast(EXACT) * F.lit(SCALE), (F.col(total) + F.col("v")).cast(EXACT))


# --- pairs ------------------------------------------------------------------------

def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / q); shares are at most 10^9 + 1, so the square fits 64 bits."""
    apart = p - q
    return apart * apart // q


def _accumulated(index: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[tuple[int, int, int]]:
    """(group, peer, sum over common terms) of an index of terms: each the ids, shares
    and baselines of the groups that have it."""
    lengths = np.array([len(ids) for ids, _, _ in index])
    ids, shares, zeros = (np.concatenate(c) for c in zip(*index))
    begins = np.cumsum(lengths) - lengths
    places, peer = np.unique(ids, return_inverse=True)
    term = np.repeat(np.arange(len(index)), lengths)
    by_group = np.argsort(peer, kind="stable")            # rows of the group-major matrix
    for row in np.split(by_group, np.flatnonzero(np.diff(peer[by_group])) + 1):
        accumulator, touched = np.zeros(len(places), np.int64), np.zeros(len(places), bool)
        many = lengths[term[row]]
        # The postings of the row's terms, one term after the other.
        others = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many - begins[term[row]], many)
        p, b = np.repeat(shares[row], many), zeros[row[0]]
        q, c = shares[others], zeros[others]
        added = divergence(p, q) - divergence(p, c) - divergence(b, q) + divergence(b, c)
        np.add.at(accumulator, peer[others], added)
        touched[peer[others]] = True
        touched[peer[row[0]]] = False
        for k in np.flatnonzero(touched):
            yield int(places[peer[row[0]]]), int(places[k]), int(accumulator[k])


def _common_terms(shares: DataFrame) -> DataFrame:
    """(lang, id, peer, value): what the terms that two groups share add."""
    postings = shares.groupBy("lang", "term").agg(F.collect_list(F.struct("id", "p", "b")).alias("groups"))
    # A language's terms lie together, so a task sends an accumulator of few languages.
    dealt = postings.filter(F.size("groups") > 1).sortWithinPartitions("lang")

    def rows(batches: Iterator[list[list]]) -> Iterator[tuple]:
        index, held, now = [], 0, None
        for batch in batches:
            for lang, _, groups in zip(*batch):
                if index and (lang != now or held >= POSTINGS):
                    yield from ((now, *found) for found in _accumulated(index))
                    index, held = [], 0
                now = lang
                index.append(tuple(np.array([g[c] for g in groups], np.int64) for c in ("id", "p", "b")))
                held += len(groups)
        if index:
            yield from ((now, *found) for found in _accumulated(index))

    return map_rows(dealt, "lang string, id bigint, peer bigint, value bigint", rows)


def _baselines(groups: DataFrame, shares: DataFrame) -> DataFrame:
    """(lang, id, peer, value): the first three lines for all pairs of groups.

    A group's distinct shares with their numbers meet the baselines of its language in
    blocks of ``PEERS``; their sums go to the pair and to the pair the other way round.
    A group has as many distinct shares as distinct counts: the square root of its words.
    """
    distinct = shares.groupBy("lang", "id", "b", "p").agg(F.count(F.lit(1)).alias("n"))
    distinct = distinct.groupBy("lang", "id", "b", F.pmod(F.xxhash64("p"), F.lit(SLICES)).alias("slice")).agg(
        F.collect_list(F.struct("p", "n")).alias("shares"))
    peers = groups.withColumn("block", F.floor(F.col("id") / PEERS)).groupBy("lang", "block").agg(
        F.collect_list(F.struct("id", "b")).alias("peers"))
    met = distinct.join(peers, "lang").select("id", "b", "shares", "lang", "peers")

    def rows(batches: Iterator[list[list]]) -> Iterator[tuple]:
        for batch in batches:
            for mine, b, found, lang, peers in zip(*batch):
                p, n = (np.array([x[c] for x in found], np.int64)[:, None] for c in ("p", "n"))
                ids, zeros = (np.array([x[c] for x in peers], np.int64) for c in ("id", "b"))
                to, back = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
                nothing = divergence(b, zeros), divergence(zeros, np.int64(b))
                for a in range(0, len(p), PEERS):
                    part = slice(a, a + PEERS)
                    to += (n[part] * (divergence(p[part], zeros) - nothing[0])).sum(axis=0)
                    back += (n[part] * (divergence(zeros, p[part]) - nothing[1])).sum(axis=0)
                for peer, x, y in zip(ids.tolist(), to.tolist(), back.tolist()):
                    if peer != mine:
                        yield lang, mine, peer, x
                        yield lang, peer, mine, y

    empty = groups.alias("a").join(groups.alias("c"), "lang").filter("a.id <> c.id").select(
        "lang", F.col("a.id").alias("id"), F.col("c.id").alias("peer"),
        (F.col("a.v") * _floored("a.b", "c.b")).alias("value"))
    return empty.unionByName(map_rows(met, "lang string, id bigint, peer bigint, value bigint", rows))


def _floored(p: str, q: str) -> Column:
    apart = F.col(p) - F.col(q)
    return F.call_function("div", apart * apart, F.col(q))


# --- operator ---------------------------------------------------------------------

def audited(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source of a language stands from
    each other one (part ``pair``) and which terms mark it out (part ``term``).

    Terms are runs of letters a-z and characters beyond ASCII, A-Z in lower case. A
    language keeps the terms of at least ``least_docs`` of its rows. Shares, in 10^9ths,
    are smoothed by one and are whole numbers, as are all sums. ``pair`` has all other
    sources, by the sum over all kept terms; ``term`` the ``top`` kept terms that the
    source has and uses more than its language does.

    NULL text, lang and source count as ''. Rows that repeat count as rows. Groups without
    kept terms have the smoothed share of every term; where a language keeps no term all
    its pairs have the value 0, and a language's only source gives no row. An empty table
    gives an empty result. Other columns are not looked at. Sums are exact below 10^18.

    Groups are numbered by a window over the groups of a language, and its output has a
    row for each pair of them: both grow with the sources, not with the documents.
    """
    counts = written(term_counts(docs), "terms-by-group")
    terms = counts.filter("term <> ''")
    kept = terms.groupBy("lang", "term").agg(F.sum("count").alias("in_lang"), F.sum("docs").alias("docs"))
    kept = written(kept.filter(F.col("docs") >= least_docs).drop("docs"), "terms-kept")
    totals = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("in_lang").alias("lang_n"))
    mine = written(terms.drop("docs").join(kept, ["lang", "term"]), "terms-of-group")

    sums = mine.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    groups = counts.filter("term = ''").select("lang", "source").distinct()
    groups = groups.join(sums, ["lang", "source"], "left").join(totals, "lang", "left").na.fill(0, ["n", "v", "lang_n"])
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("bigint")
    zero = F.when(F.col("v") > 0, _share(F.lit(0), "n")).otherwise(1)
    groups = written(groups.select("lang", "source", "n", "v", "lang_n", number.alias("id"), zero.cast("bigint").alias("b")), "terms-groups")

    shares = mine.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", "id", "b",
        _share("count", "n").cast("bigint").alias("p"), _share("in_lang", "lang_n").cast("bigint").alias("q"))
    shares = written(shares, "terms-shares")

    added = _common_terms(shares.select("lang", "term", "id", "p", "b"))
    added = _baselines(groups, shares).unionByName(added)
    summed = added.groupBy("lang", "id", "peer").agg(F.sum(F.col("value").cast(EXACT)).cast("bigint").alias("value"))
    named = groups.select("lang", "id", "source")
    pairs = summed.join(named, ["lang", "id"]).join(
        named.select("lang", F.col("id").alias("peer"), F.col("source").alias("item")), ["lang", "peer"])
    marked = shares.filter("p > q").select("lang", "source", F.col("term").alias("item"), _floored("p", "q").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    pairs = pairs.withColumn("part", F.lit("pair")).withColumn("rank", rank)
    marked = marked.withColumn("part", F.lit("term")).withColumn("rank", rank).filter(F.col("rank") <= top)
    return pairs.select(*columns).unionByName(marked.select(*columns))

"""Personal data by pattern, and terms that reveal it by corpus co-occurrence.

Patterns find e-mail addresses, IP addresses, card and phone numbers. Other words can
give such an entity away when they hardly occur without it. How strongly a term t
reveals an entity e is the pointwise mutual information of their documents against the
information e itself carries,

    PMI(e; t) / IC(e),   PMI = log(N n_et / (n_e n_t)),   IC = log(N / n_e),

which is 1 when t occurs with e only. All terms of a document that mentions e are
looked at, and all counts are of documents. Few documents say little: in place of
n_et / n_t stands the lower bound of its Wilson interval, at ``DEVIATIONS`` standard
deviations, where documents with e in the same surroundings, as copies have, count once.

A term that was seen with e in one surrounding only, so most words of any text, is no
evidence by that, however large the corpus. It has to stand beside the mention in every
document that it occurs in, and that must be no chance: in none of them may more than
``BY_CHANCE`` of the words stand beside a mention.

A term is generalised to its kind from ``GENERALISE`` on and removed from ``REMOVE`` on,
wherever it stands.
"""

from __future__ import annotations

import re
import uuid
from bisect import bisect_left
from collections import Counter
from collections.abc import Container, Iterator
from itertools import accumulate

from pyspark.sql import Column, DataFrame, functions as F
from xxhash import xxh64_intdigest

from solvenza.llm.common import map_rows, text_key, unused, written

# The kinds in their order, and their patterns.
KINDS = ("email", "ip", "card", "phone")
TERM = "term"
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_NO_DIGITS = re.compile("[^0-9]+")

NEAR = 8                # words on either side of a mention, on its line, tell surroundings apart
LEAST_CHARS = 3         # of a term
LONGEST = 64            # characters of a term; a hash stands for a longer one
DEVIATIONS = 1.0
GENERALISE, REMOVE = 0.9, 0.95
BY_CHANCE = 1 / 16
HELD = 200_000          # terms that a task counts at a time
BITS = 1 << 26          # of the table of terms that every task holds, whatever their number

_TERM = re.compile(r"\w+")
MARKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}


def _strip_zeros(digits: str) -> str:
    return digits.lstrip("0")


def luhn(digits: str) -> bool:
    doubled = "0246813579"
    total = sum(map(int, digits[-1::-2])) + sum(int(doubled[int(d)]) for d in digits[-2::-2])
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from their @: the address starts where the run of
    characters before it does, but not before the end of the last match."""
    at, floor = text.find("@"), 0
    while at >= 0:
        before = text[floor:at]
        start = floor + len(before.rstrip(LOCAL))
        if start < at and (found := _DOMAIN.match(text, at + 1)):
            end = found.end()
            yield start, end
            floor, at = end, text.find("@", end)
        else:
            floor, at = at + 1, text.find("@", at + 1)


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of all pattern matches, in order; code points, end
    exclusive. A match that fails its check is dropped, and the search goes on after it."""
    found = []
    if not text:
        return found
    if "@" in text:
        found += [(a, 0, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in map(_strip_zeros, m[0].split("."))):
                found.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_NO_DIGITS.sub("", m[0])) <= 15:
                    found.append((m.start(), 3, m.end()))
    return sorted(found)


def spelled(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def named(word: str) -> str:
    """The term of a word, of bounded length."""
    term = word.lower()
    return term if len(term) <= LONGEST else f"#{xxh64_intdigest(term.encode()):016x}"


def entities(text: str, spans: list[tuple[int, int, int]]) -> tuple[list[tuple[str, int]], dict[int, int]]:
    """Each entity of the text once, with a hash of the words near its first mention; and
    the words near any mention, as ends by start."""
    found, beside, stretch = {}, {}, 32 * NEAR
    taken = _reach(spans)
    for a, k, b in spans:
        left = max(text.rfind("\n", 0, a) + 1, a - stretch)
        right = text.find("\n", b)
        right = min(len(text) if right < 0 else right, b + stretch)
        # A word that the stretch cuts is no word of the text.
        before = [m for m in _TERM.finditer(text, left, a) if m.start() > left or left == 0 or text[left - 1] == "\n"]
        after = [m for m in _TERM.finditer(text, b, right) if m.end() < right or right == len(text) or text[right] == "\n"]
        near = [m for m in (*before[-NEAR:], *after[:NEAR]) if not _touches(m, taken)]
        beside.update((m.start(), m.end()) for m in near)
        around = xxh64_intdigest(" ".join(m[0].lower() for m in near).encode()) >> 1
        found.setdefault(f"{KINDS[k]}:{text[a:b].lower()}", around)
    return list(found.items()), beside


def _reach(spans: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    """Starts of the spans, and how far those up to each one reach."""
    return [a for a, _, _ in spans], list(accumulate((b for *_, b in spans), max))


def _touches(m: re.Match, reach: tuple[list[int], list[int]]) -> bool:
    i = bisect_left(reach[0], m.end())
    return i > 0 and reach[1][i - 1] > m.start()


def places(text: str, spans: list[tuple[int, int, int]], wanted: Container[str] | None = None) -> list[tuple]:
    """(term, starts, ends) of the words of the text, or of those that may be wanted.
    Words that touch any match are no terms."""
    found: dict[str, tuple[list[int], list[int]]] = {}
    taken = _reach(spans)
    for m in _TERM.finditer(text):
        if m.end() - m.start() >= LEAST_CHARS:
            term = named(m[0])
            if (wanted is None or term in wanted) and not _touches(m, taken):
                starts, ends = found.setdefault(term, ([], []))
                starts.append(m.start())
                ends.append(m.end())
    return [(term, *at) for term, at in found.items()]


FOUND = (
    "row bigint, key bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base string, "
    "spans array<struct<start: int, kind: int, `end`: int>>, "
    "entities array<struct<entity: string, around: bigint>>, chance double, "
    "terms array<struct<term: string, starts: array<int>, ends: array<int>, near: boolean>>"
)


def found(docs: DataFrame) -> DataFrame:
    """Pattern matches of every document, and all terms of those that have any, with
    whether they stand beside a match; ``chance`` is the share of words that do. ``row``
    tells equal rows apart; it is random, so the table has to be written before use."""
    def rows(batches: Iterator[list[list]]) -> Iterator[tuple]:
        for keys, doc_ids, texts in batches:
            for key, doc_id, text in zip(keys, doc_ids, texts):
                spans = base_spans(text)
                counts = [sum(k == n for _, k, _ in spans) for n in range(len(KINDS))]
                known, terms, chance = [], [], 0.0
                if spans:
                    known, beside = entities(text, spans)
                    terms = [(t, a, b, any(x in beside for x in a)) for t, a, b in places(text, spans)]
                    chance = len(beside) / max(1, sum(len(a) for _, a, _, _ in terms))
                yield (doc_id, uuid.uuid4().int >> 65, key, *counts, spelled(spans), spans, known, chance, terms)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_rows(docs.select(text_key().alias("key"), "doc_id", "text"), f"doc_id {kind}, {FOUND}", rows)


class Table:
    """Terms by one bit of a hash each: what is in has its bit set, and few others do."""

    def __init__(self, bits: bytearray):
        self.bits, self.mask = bits, 8 * len(bits) - 1

    def __contains__(self, term: str) -> bool:
        at = xxh64_intdigest(term.encode(), 42) & self.mask
        return bool(self.bits[at >> 3] >> (at & 7) & 1)


def table_of(terms: DataFrame, bits: int) -> Table:
    """The table of a ``term`` column. Its size is fixed: the more terms, the more others
    pass, and a join tells those apart. Spark combines the bits by blocks of 4 KB."""
    at = F.pmod(F.xxhash64("term"), F.lit(bits)) + 1
    blocks = terms.groupBy(F.bitmap_bucket_number(at).alias("block")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    found = bytearray(max(bits, 1 << 15) // 8)
    for r in blocks.toLocalIterator():
        start = (r.block - 1) << 12
        found[start: start + len(r.bits)] = r.bits
    return Table(found[: bits // 8])


def _held_in(text: str, table: Table) -> set[str]:
    """The terms of a text that may be in the table."""
    return {t for t in set(map(named, set(_TERM.findall(text)))) if t in table}


def _documents_with(docs: DataFrame, terms: DataFrame, bits: int) -> DataFrame:
    """(term, n_t): documents, of all, that hold each of the terms."""
    wanted = docs.sparkSession.sparkContext.broadcast(table_of(terms, bits))

    def rows(batches: Iterator[list[list]]) -> Iterator[tuple]:
        counts: Counter = Counter()
        table = wanted.value
        for (texts,) in batches:
            for text in texts:
                if text:
                    counts.update(_held_in(text, table))
                if len(counts) > HELD:
                    yield from counts.items()
                    counts.clear()
        yield from counts.items()

    partial = map_rows(docs.select("text"), "term string, n bigint", rows)
    counted = partial.groupBy("term").agg(F.sum("n").alias("n_t"))
    return counted.join(terms, "term", "left_semi")


def _log_lower(n_et: Column, n_t: Column, texts: Column) -> Column:
    """Logarithm of the lower bound of n_et / n_t when ``texts`` of the n_et are independent."""
    p, z2 = n_et / n_t, DEVIATIONS ** 2
    n = texts / p
    spread = F.sqrt(z2 * (p * (1 - p) / n + z2 / (4 * n * n)))
    return F.log((p + z2 / (2 * n) - spread) / (1 + z2 / n))


def revealing(docs: DataFrame, seen: DataFrame, bits: int = BITS) -> DataFrame:
    """(term, action, wider) of the terms that reveal an entity; ``wider`` tells those
    that may also stand in documents without any entity.

    Entities of the same documents reveal and are revealed alike, so the smallest stands
    for them, and so it is with terms of the same documents: a list of addresses that is
    stored twice is one entity and one term.
    """
    total = seen.count()
    texts = seen.filter(F.size("entities") > 0).select(
        F.col("row").alias("text"), "entities", "chance",
        F.transform("terms", lambda t: F.struct(t["term"].alias("term"), t["near"].alias("near"))).alias("terms"),
    )
    same = F.sum(F.xxhash64("text").cast("decimal(38,0)")).alias("same")
    mentions = written(texts.select("text", F.explode("entities").alias("e")).select("text", "e.*"), "pii-mentions")
    counted = mentions.groupBy("entity").agg(F.count(F.lit(1)).alias("n_e"), same)
    kept = counted.groupBy("n_e", "same").agg(F.min("entity").alias("entity")).filter(F.col("n_e") < total)
    # The share cannot reach its limit where n_t exceeds n_e (N / n_e) ** (1 - limit).
    most = F.col("n_e") * F.pow(total / F.col("n_e"), F.lit(1 - GENERALISE)) * (1 + 1e-9)
    kept = written(kept.select("entity", "n_e", most.alias("most")), "pii-entities")
    mentions = written(mentions.join(kept, "entity"), "pii-kept")
    bound = mentions.groupBy("text").agg(F.max("most").alias("most"))
    held = texts.join(bound, "text").select("text", "chance", "most", F.explode("terms").alias("t"))
    held = written(held.select("text", "chance", "most", "t.*"), "pii-terms-held")
    beside = F.min("near") & (F.max("chance") <= BY_CHANCE)
    inside = held.groupBy("term").agg(
        F.count(F.lit(1)).alias("n_in"), F.max("most").alias("most"), beside.alias("beside"), same)
    terms = written(inside.filter("n_in <= most AND (n_in > 1 OR beside)"), "pii-terms")
    if terms.isEmpty():
        return terms.select("term", F.lit("").alias("action"), F.lit(False).alias("wider"))
    with_term = _documents_with(docs, terms.select("term"), bits).join(terms, "term")
    with_term = written(with_term.filter("n_t <= most AND (n_in > 1 OR n_t = 1)").drop("most"), "pii-counts")

    several = with_term.filter("n_in > 1")
    alike = ["n_in", "n_t", "same"]
    first = written(several.groupBy(*alike).agg(F.min("term").alias("term")), "pii-classes")
    rare = written(held.join(first, "term").filter("n_t <= most").select("text", *alike), "pii-rare")
    pairs = rare.join(mentions.select("text", "entity", "around", "n_e"), "text")
    pair = ["entity", *alike, "n_e"]
    around = pairs.groupBy(*pair, "around").agg(F.count(F.lit(1)).alias("n"))
    judged = around.groupBy(*pair).agg(F.sum("n").alias("n_et"), F.count(F.lit(1)).alias("texts"))
    share = 1 + _log_lower(F.col("n_et"), F.col("n_t"), F.col("texts")) / F.log(total / F.col("n_e"))
    # Copies of one text only, and always with the entity.
    alone = (F.col("texts") == 1) & (F.col("n_et") == F.col("n_t"))
    best = judged.groupBy(*alike).agg(
        F.max(F.when(F.col("texts") > 1, share)).alias("share"), F.max(alone).alias("alone"))
    best = best.filter((F.col("share") >= GENERALISE) | F.col("alone"))

    flagged = several.join(best, alike).filter((F.col("share") >= GENERALISE) | (F.col("alone") & F.col("beside")))
    action = F.when(F.col("share") >= REMOVE, "remove").otherwise("generalise")
    flagged = flagged.select("term", action.alias("action"), (F.col("n_t") > F.col("n_in")).alias("wider"))
    lone = with_term.filter("n_in = 1").select("term", F.lit("generalise").alias("action"), F.lit(False).alias("wider"))
    return flagged.unionByName(lone)


def _elsewhere(docs: DataFrame, flagged: DataFrame, bits: int) -> DataFrame:
    """(key, term, starts, ends) of the flagged terms in documents without any entity."""
    wanted = docs.sparkSession.sparkContext.broadcast(table_of(flagged, bits))

    def rows(batches: Iterator[list[list]]) -> Iterator[tuple]:
        for keys, texts in batches:
            for key, text in zip(keys, texts):
                if text and (held := _held_in(text, wanted.value)) and not base_spans(text):
                    for found in places(text, [], held):
                        yield key, *found

    schema = "key bigint, term string, starts array<int>, ends array<int>"
    found = map_rows(docs.select(text_key().alias("key"), "text"), schema, rows)
    return found.join(flagged, "term", "left_semi")


def added_spans(docs: DataFrame, seen: DataFrame, bits: int = BITS) -> DataFrame:
    """(key, added): the spans of revealing terms by document, start, end and action."""
    flagged = written(revealing(docs, seen, bits), "pii-revealing")
    places = seen.select("key", F.explode("terms").alias("t")).select("key", "t.term", "t.starts", "t.ends")
    wider = flagged.filter("wider").select("term")
    if not wider.isEmpty():
        places = places.unionByName(_elsewhere(docs, wider, bits))
    hits = places.join(flagged.select("term", "action"), "term")
    # Rows equal in id and text have one key.
    hits = hits.dropDuplicates(["key", "term"])
    spans = F.zip_with("starts", "ends", lambda a, b: F.struct(a.alias("start"), b.alias("end"), F.col("action")))
    listed = hits.select("key", spans.alias("spans")).groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("added"))
    return listed.select("key", F.sort_array("added").alias("added"))


def detected(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base, base_sha256, spans and added spans.

    ``base`` and ``spans`` are kind:start:end in code points, end exclusive, by start and
    kind, joined by commas; ``spans`` also has the terms, ``added`` has their actions.
    NULL and empty texts have no spans. Rows equal in doc_id and text have equal results,
    NULL and repeated doc_ids are handed on. Only doc_id and text are read. An empty
    table gives an empty result.
    """
    seen = written(found(docs), "pii-found")
    out = seen.drop("row", "terms", "entities", "chance").join(added_spans(docs, seen, bits), "key", "left")
    struct = "array<struct<start: int, kind: int, `end`: int>>"
    terms = F.transform(F.coalesce("added", F.array().cast("array<struct<start:int,`end`:int,action:string>>")),
                        lambda s: F.struct(s["start"], F.lit(len(KINDS)).alias("kind"), s["end"]))
    names = F.array(*[F.lit(k) for k in (*KINDS, TERM)])
    every = F.sort_array(F.concat("spans", terms.cast(struct)))
    spell = F.transform(every, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"]))
    return out.select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"),
        F.array_join(spell, ",").alias("spans"), "base", "added",
    )


def _general(word: str) -> str:
    return "[NUMBER]" if word.isdigit() else "[NAME]" if word[:1].isupper() else "[TERM]"


def masked(text: str | None, added: list | None) -> str | None:
    """The text with its matches named by kind, revealing terms generalised or removed.
    Where spans overlap, the first one names all that they cover."""
    if not text:
        return text
    spans = [(a, b, MARKS[KINDS[k]]) for a, k, b in base_spans(text)]
    for s in added or []:
        a, b, action = s["start"], s["end"], s["action"]
        spans.append((a, b, "" if action == "remove" else _general(text[a:b])))
    out, at = [], 0
    for a, b, mark in sorted(spans):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def sanitised(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """All rows and columns of ``docs`` with the text masked; NULL texts stay NULL."""
    seen = written(found(docs), "pii-found")
    key, extra = unused(docs, "_key"), unused(docs, "_added")
    added = written(added_spans(docs, seen, bits), "pii-added").select(
        F.col("key").alias(key), F.col("added").alias(extra)
    )
    # Texts without added spans are the most by far; where the added ones are few,
    # adaptive execution sends those and the texts stay where they are.
    joined = docs.withColumn(key, text_key()).join(added, key, "left").drop(key)
    names = [*docs.columns, extra]
    place = names.index("text")

    def rows(batches: Iterator[list[list]]) -> Iterator[tuple]:
        for batch in batches:
            for row in zip(*batch):
                yield (*row[:place], masked(row[place], row[-1]), *row[place + 1:-1])

    return map_rows(joined.select(*names), docs.schema, rows)

"""Divergence of sources against a dense computation over all terms."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import types as T

from solvenza.llm import divergence

from .conftest import EDGES, EXTRA

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, top):
    counts, within, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source, found = lang or "", source or "", TERM.findall((text or "").translate(LOWER))
        groups.add((lang, source))
        counts[lang, source].update(found)
        within[lang].update(set(found))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in within[lang].items() if n >= 3]
        mine = {s: counts[lang, s] for a, s in groups if a == lang}
        share = lambda c: {
            t: 1 + 10**9 * (c[t] + 1) // (sum(c[k] for k in kept) + len(kept)) for t in kept}
        shares = {s: share(c) for s, c in mine.items()}
        all_of = share(sum(mine.values(), Counter()))
        for s, p in shares.items():
            pairs = [(sum((p[t] - q[t]) ** 2 // q[t] for t in kept), o) for o, q in shares.items() if o != s]
            terms = [((p[t] - all_of[t]) ** 2 // all_of[t], t) for t in kept if mine[s][t] and p[t] > all_of[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda f: (-f[0], f[1].encode()))
                ranked = found if part == "pair" else found[:top]
                out += [(lang, s, part, item, v, k) for k, (v, item) in enumerate(ranked, 1)]
    return sorted(out)


@pytest.fixture
def sources(spark):
    def make(rows):
        schema = T.StructType()
        for name in ("lang", "source", "text", *EXTRA, "term", "id", "value"):
            schema = schema.add(name, "string")
        return spark.createDataFrame([(*r, *schema.names[3:]) for r in rows], schema)

    return make


def corpus():
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdeéß", k=rng.randint(1, 5))) for _ in range(120)]
    rows = []
    for lang in ("en", "de", None):
        for source in ("a", "b", "B", "é", None, "only symbols"):
            for _ in range(rng.randint(1, 9)):
                mine = words[: rng.randint(5, 120)] if source != "only symbols" else ["1", "-"]
                rows.append((lang, source, rng.choice([" ", "\n", "1"]).join(rng.choices(mine, k=rng.randint(0, 80))).title()))
    return [*rows, *rows[:4], ("xx", "one", "alone here"), ("yy", "s", None), ("yy", "t", "")]


def found(df, top=divergence.TOP_TERMS):
    got = divergence.audited(df, top=top)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert dict(got.dtypes)["value"] == "bigint" and dict(got.dtypes)["rank"] == "int"
    return sorted(map(tuple, got.collect()))


def test_equals_the_dense_sums(sources, monkeypatch):
    rows = corpus()
    assert found(sources(rows), 7) == plain(rows, 7)
    # Small bounds: tasks send what they hold early, and a group meets several blocks.
    for name, value in (("HELD_TERMS", 20), ("HELD_BYTES", 500), ("TEXT_BLOCK", 64), ("POSTINGS", 9), ("PEERS", 2)):
        monkeypatch.setattr(divergence, name, value)
    assert found(sources(rows)) == plain(rows, divergence.TOP_TERMS)


def test_edges(sources):
    rows = [("en", f"s{(i or 0) % 2}", t) for i, t in EDGES]
    assert found(sources(rows)) == plain(rows, divergence.TOP_TERMS)
    assert found(sources([])) == []


def test_a_text_of_several_blocks_is_one_document(sources, monkeypatch):
    monkeypatch.setattr(divergence, "TEXT_BLOCK", 40)
    text = "once " * 30 + "x" * 200 + " twice" * 30
    rows = [("en", "a", text), ("en", "b", text), ("en", "b", "once or"), ("en", "c", "or or"), ("en", "a", "or")]
    assert found(sources(rows)) == plain(rows, divergence.TOP_TERMS)

"""Fingerprints, links and components against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from solvenza.llm import simhash
from solvenza.llm.components import components

from .conftest import EDGES


def plain_fingerprint(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    runs = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("text", [None, "", " \n", "A b", "Ä B c D", "x\x0by\x0cz w\xa0v", "a b c " * 30_000])
def test_fingerprint(text):
    assert simhash.fingerprint(text) & (1 << 64) - 1 == plain_fingerprint(text)


def near(fp, bits, random):
    for b in random.sample(range(64), bits):
        fp ^= 1 << b
    return fp


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("most", [simhash.MEET_MOST, 3])
def test_links_connect_what_all_pairs_connect(spark, most):
    rng = random.Random(1)
    fps = [rng.getrandbits(64) for _ in range(60)]
    for bits in (1, 2, 3, 4):
        fps += [near(f, bits, rng) for f in fps[:40]]
    fps += [near(fps[0], rng.randint(1, 3), rng) for _ in range(60)]  # one crowded neighbourhood
    fps = sorted({signed(f) for f in fps})
    table = spark.createDataFrame([(f,) for f in fps], "fp bigint")
    links = simhash.links(table, most)
    assert all(bin((r.a ^ r.b) & (1 << 64) - 1).count("1") <= 3 for r in links.collect())
    roots = {r.node: r.root for r in components(links).collect()}
    expected = plain_components([f & (1 << 64) - 1 for f in fps])
    assert [roots.get(f, f) for f in fps] == [fps[i] for i in expected]


def test_groups_that_batches_cut():
    keys, fps = [1, 1, 1, 2, 3, 3], [0, 1, 3, 9, 8, 0xFF << 40]
    table = pa.table({"variant": pa.array(keys, pa.int64()), "fp": pa.array(fps, pa.int64())})
    for size in (1, 2, 6):
        batches = table.to_batches(max_chunksize=size)
        out = [r for b in simhash._meetings(iter(batches), 10) for r in zip(*b.to_pydict().values())]
        assert {frozenset(r) for r in out} == {frozenset((0, 1)), frozenset((0, 3))}


def test_near_duplicates(documents):
    rows = EDGES + [(20, "alpha beta gamma delta " * 30), (21, "alpha beta gamma delta " * 30 + "omega")]
    found = {(r.doc_id, r.fp): r.component_id for r in simhash.near_duplicates(documents(rows)).collect()}
    fps = [plain_fingerprint(t) for _, t in rows]
    roots = plain_components(fps)
    for (doc_id, _), fp, root in zip(rows, fps, roots):
        ids = [i for (i, _), r in zip(rows, roots) if r == root and i is not None]
        assert found[doc_id, signed(fp)] == min(ids, default=None)


def test_representatives_keep_one_row_and_all_columns(documents):
    docs = documents([(3, "a b c"), (1, "a b c"), (1, "a b c"), (None, "a b c"), (9, "other words entirely"), (None, None)])
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == [(0, ""), (1, "a b c"), (9, "other words entirely")]


def test_empty(documents):
    assert simhash.near_duplicates(documents([])).collect() == []
    assert simhash.representatives(documents([])).collect() == []


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    roots = {r.node: r.root for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert roots == {**{i: 0 for i in range(31)}, **{100 + i: 100 for i in range(30)}}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []

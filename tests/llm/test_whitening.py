"""Whitened vectors against plain linear algebra over the distinct vectors."""

import math

import numpy as np
import pytest

from solvenza.llm import whitening


@pytest.fixture
def embeddings(spark):
    def make(vectors, kind="float"):
        schema = f"vec_id long, embedding array<{kind}>, copies string, d string, n string"
        return spark.createDataFrame([(i, v, "c", "d", "n") for i, v in enumerate(vectors)], schema)

    return make


def plain(vectors, counts=False, components=4):
    """{row: [(n, deviation, |whitened|, explained)]}"""
    x = {i: tuple(math.floor(256 * float(np.float32(c))) + 0 for c in v) for i, v in enumerate(vectors)}
    distinct = sorted(set(x.values()))
    w = np.array([list(x.values()).count(v) if counts else 1 for v in distinct])
    n, sums = int(w.sum()), [sum(int(k) * v[j] for k, v in zip(w, distinct)) for j in range(len(distinct[0]))]
    m = np.array(distinct, float) - np.array([s / n for s in sums])
    cov = (m * w[:, None]).T @ m / n
    values, axes = np.linalg.eigh(cov)
    order = np.argsort(-values)[:components]
    out = {}
    for i, v in x.items():
        projected = (np.array(v) - np.array([s / n for s in sums])) @ axes[:, order] / np.sqrt(values[order])
        deviation = sum((n * c - s) ** 2 for c, s in zip(v, sums))
        out[i] = [(n, deviation, abs(p), values[k] / np.trace(cov)) for p, k in zip(projected, order)]
    return out


def vectors(n=400, d=6, seed=1):
    rng = np.random.default_rng(seed)
    found = (rng.normal(size=(n, d)) * np.arange(d, 0, -1) * 0.3 + rng.normal(size=d)).astype(np.float32).tolist()
    return found + found[:30] + [found[5]] * 150


@pytest.mark.parametrize("counts", [False, True])
def test_equals_plain_algebra(embeddings, counts):
    rows = vectors()
    got = whitening.whitened(embeddings(rows), counts=counts)
    assert got.columns == [
        "vec_id", "embedding", "copies", "d", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    expected, signs, errors = plain(rows, counts), {}, set()
    rows = got.collect()
    assert len(rows) == 4 * len(expected)
    for r in rows:
        n, deviation, size, explained = expected[r.vec_id][r.component - 1]
        assert (r.n, r.deviation) == (n, deviation)
        assert abs(r.whitened) == pytest.approx(size, rel=1e-9, abs=1e-9)
        assert r.explained == pytest.approx(explained, rel=1e-9)
        errors.add(r.identity_error)
    assert len(errors) == 1 and errors.pop() < 1e-9


def test_sign_is_one_for_all_rows(embeddings):
    rows = vectors(60)
    got = {(r.vec_id, r.component): r.whitened for r in whitening.whitened(embeddings(rows)).collect()}
    x = np.array([[math.floor(256 * float(np.float32(c))) for c in v] for v in rows], float)
    fit = np.unique(x, axis=0)
    for k in range(1, 5):
        w = np.array([got[i, k] for i in range(len(rows))])
        axis = np.linalg.lstsq(x - fit.mean(axis=0), w, rcond=None)[0]
        assert np.allclose((x - fit.mean(axis=0)) @ axis, w)


def test_edges(embeddings):
    nan, inf = float("nan"), float("inf")
    rows = [None, [], [nan, 1.0], [None, 1.0], [inf, 0.0], [0.5, -0.0], [0.5, 0.25], [0.25, 0.5], [1.0, 1.0], [1.0, 1.0]]
    rows += [[3.0], [4.0], [1.0, 2.0, 3.0]]
    found = whitening.whitened(embeddings(rows)).collect()
    assert {(r.vec_id, r.component) for r in found} == {
        *((i, k) for i in (5, 6, 7, 8, 9) for k in (1, 2)), (10, 1), (11, 1), *((12, k) for k in (1, 2, 3))}
    two = {r.vec_id: r.whitened for r in found if r.vec_id in (10, 11)}
    assert sorted(two.values()) == pytest.approx([-1, 1])
    alone = [r for r in found if r.vec_id == 12]
    assert all(r.whitened is None and r.explained == 0 and r.identity_error is None and r.deviation == 0 for r in alone)
    assert whitening.whitened(embeddings([])).collect() == []
    assert whitening.whitened(embeddings([None, []])).collect() == []


def test_large_entries(embeddings):
    rows = [[1e300, 0.0], [-1e300, 1.0], [2.0, 3e16], [1.0, 5.0]]
    found = whitening.whitened(embeddings(rows, "double")).collect()
    assert len(found) == 8 and all(np.isfinite(r.whitened) for r in found)
    assert {r.vec_id for r in found if r.deviation is None}


def test_dependent_dimensions(embeddings):
    rows = [[a / 4, a / 2, 0.5] for a in range(20)]
    found = whitening.whitened(embeddings(rows)).collect()
    assert len(found) == 60
    assert all((r.whitened is None) == (r.component > 1) for r in found)
    assert all(r.identity_error < 1e-9 for r in found)


def test_exact_sums():
    x = np.array([[2**63 - 1, -(2**63)], [5, -7]], np.int64)
    w = np.array([3, 70_000])
    assert whitening._weighted_sums(x, w) == [3 * (2**63 - 1) + 350_000, -3 * 2**63 - 490_000]

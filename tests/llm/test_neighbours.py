"""Recall against brute force, exact scores, and vectors that take no part."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from solvenza.llm import neighbours
from solvenza.llm.neighbours import nearest_neighbours

SCHEMA = "vec_id long, embedding array<{}>, label int, node long, code string, key string"


def table(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, 0, 1, "c", "k") for i, v in rows], SCHEMA.format(kind))


def answers(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def plain(vectors, query, top=5):
    x = np.array(vectors[query], np.float32).astype(float)
    scored = []
    for i, v in vectors.items():
        y = np.array(v, np.float32).astype(float)
        if i != query:
            scored.append((-round(float(x @ y / np.sqrt((x @ x) * (y @ y))), 12), i))
    return [i for _, i in sorted(scored)[:top]]


@pytest.mark.parametrize("block", [2048, 64])
def test_recall_and_scores(spark, block):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((12, 16))
    points = [centres[i % 12] * (i % 3) + rng.standard_normal(16) for i in range(600)]
    vectors = {i: [float(x) for x in p] for i, p in enumerate(points)}
    found = answers(nearest_neighbours(table(spark, vectors.items()), F.col("vec_id") % 20 == 0, block=block))
    assert set(found) == set(range(0, 600, 20))
    hits = sum(len({i for i, _ in found[q]} & set(plain(vectors, q))) for q in found)
    assert hits / (5 * len(found)) >= 0.95
    for q, near in found.items():
        scores = [s for _, s in near]
        assert scores == sorted(scores, reverse=True)
        for i, s in near:
            x, y = (np.array(vectors[k], np.float32).astype(float) for k in (q, i))
            assert s == pytest.approx(x @ y / np.sqrt((x @ x) * (y @ y)), abs=1e-12)


def test_vectors_that_take_no_part_ties_and_copies(spark):
    one = [1.0, 0.0, 0.0]
    rows = [
        (0, one), (1, one), (2, one), (3, one), (4, one), (5, one), (6, one), (7, [0.0, 1.0, 0.0]), (8, None),
        (9, [0.0, 0.0, 0.0]), (10, [float("nan"), 1.0, 1.0]), (11, [float("inf"), 1.0, 1.0]), (12, [None, 1.0, 1.0]),
        (13, [1.0, 0.0]), (None, one), (14, [1.0, -0.0, 0.0]), (7, [0.0, 1.0, 0.0]),
    ]
    found = answers(nearest_neighbours(table(spark, rows), F.col("vec_id") % 7 == 0))
    assert [i for i, _ in found[0]] == [1, 2, 3, 4, 5]
    assert [i for i, _ in found[7]] == [0, 1, 2, 3, 4]
    assert [i for i, _ in found[14]] == [0, 1, 2, 3, 4]
    assert set(found) == {0, 7, 14}


def test_fewer_candidates_than_asked_for(spark):
    assert [i for i, _ in answers(nearest_neighbours(table(spark, [(0, [1.0, 0.0]), (1, [0.0, 1.0])]), F.col("vec_id") == 0))[0]] == [1]
    assert nearest_neighbours(table(spark, [(0, [1.0, 0.0])]), F.col("vec_id") == 0).collect() == []
    assert nearest_neighbours(table(spark, []), F.col("vec_id") == 0).collect() == []
    assert nearest_neighbours(table(spark, [(0, None)]), F.col("vec_id") == 0).collect() == []


def test_tiny_and_huge_vectors(spark):
    rows = [(0, [1.0, 2.0]), (1, [1e-200, 2e-200]), (2, [3.0, 1.0]), (3, [1e200, -2e200]), (4, [5e-324, 0.0]), (5, [1.7e308, 1.7e308])]
    found = answers(nearest_neighbours(table(spark, rows, "double"), F.col("vec_id") >= 0))
    units = {i: np.array(v) / max(map(abs, v)) for i, v in rows}
    for q, near in found.items():
        assert len(near) == 5
        for i, s in near:
            x, y = units[q], units[i]
            assert s == pytest.approx(x @ y / np.sqrt((x @ x) * (y @ y)), abs=1e-12)
    assert found[0][0][0] == 1 and found[0][-1] == (3, pytest.approx(-0.6))


def test_search_among_near_copies_takes_few_rounds(spark, monkeypatch):
    """A beam that moves on through a crowd expands more in each round."""
    rng = np.random.default_rng(5)
    crowd, rounds = rng.standard_normal(16), []
    vectors = {i: [float(x) for x in crowd + 0.02 * rng.standard_normal(16)] for i in range(900)}
    plainly = neighbours.written
    monkeypatch.setattr(neighbours, "written", lambda df, purpose: rounds.append(purpose) or plainly(df, purpose))
    found = answers(nearest_neighbours(table(spark, vectors.items()), F.col("vec_id") % 100 == 0, nearest=8))
    hits = sum(len({i for i, _ in found[q]} & set(plain(vectors, q))) for q in found)
    assert rounds.count("nn-state") <= 7 and hits >= 0.9 * 45


def test_merged_links(spark):
    rows = [(1, [7, 8, 9], [0.5, 0.5, 0.1], [False, True, False]), (1, [9, 7, 5], [0.75, 0.5, 0.5], [True, True, True]),
            (2, [1], [-0.5], [True])]
    links = spark.createDataFrame(rows, neighbours.GRAPH)
    out = {r.node: (r.ids, r.sims, r.fresh) for r in neighbours._merged(links, 3).collect()}
    assert out == {1: ([9, 5, 7], [0.75, 0.5, 0.5], [True, True, False]), 2: ([1], [-0.5], [True])}

"""Counts against brute force, and the distance's verdict."""

import math
import re
from collections import Counter

from solvenza.llm import quality

from .conftest import EDGES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PROSE = "The quick brown fox jumps over the lazy dog and runs to the river in the morning for that is its way. "


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [s for s in text.split("\n") if WORD.search(s)]
    runs = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    many, covered = Counter(runs), set()
    for i, r in enumerate(runs):
        if many[r] > 1:
            covered |= {i, i + 1, i + 2}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)),
            len(covered), len(words) < 50 or 100 * len(covered) > 50 * len(words))


def test_counts(documents):
    rows = EDGES + [
        (20, "a b c a b c x a b c"), (21, "x\n\nx\nx \n \ny\r\ny\r\n"), (22, "a a a a a"), (23, "#*$ %&| <> 日本 \xa0b"),
        (24, "\x0bz\x0cz z z\x1cz "),
    ]
    found = Counter(tuple(r)[:7] for r in quality.judged(documents(rows)).collect())
    assert found == Counter((i, *plain(t)) for i, t in rows)


def test_unlike_texts_are_rejected(documents):
    good = [(i, f"{PROSE} Number {i} " + " ".join(f"word{chr(97 + i % 26)}{chr(97 + j % 26)}{'q' * (j // 26)} the" for j in range(60))) for i in range(40)]
    marks = (99, " ".join(f"w{j}###*** Q{j}%%%" for j in range(80)))
    verdict = {r.doc_id: r for r in quality.judged(documents(good + [marks])).collect()}
    assert all(verdict[i].kept for i, _ in good)
    assert not verdict[99].base_failed and not verdict[99].kept
    assert verdict[99].chars_distance > quality.CHARS_LIMIT > verdict[3].chars_distance


def test_short_texts_and_unknown_languages_have_no_distance(documents):
    rows = [(1, "the " * 20), (2, PROSE * 5)]
    found = {r.doc_id: r for r in quality.judged(documents(rows, lang="xx")).collect()}
    assert found[1].chars_distance is None and found[1].words_distance is None
    assert found[2].chars_distance is not None and found[2].words_distance is None


def test_null_language_and_empty_table(documents):
    assert len(quality.judged(documents(EDGES, lang=None)).collect()) == len(EDGES)
    assert quality.judged(documents([])).collect() == []


def test_distance_of_disjoint_and_equal_shares(spark):
    from pyspark.sql import functions as F
    one = spark.range(1).select(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), F.lit(0.0).alias("ref_a"), F.lit(1.0).alias("ref_b"))
    assert math.isclose(one.select(quality.distance(("a", "b"))).first()[0], 1.0)
    same = spark.range(1).select(F.lit(0.3).alias("a"), F.lit(0.7).alias("b"), F.lit(0.3).alias("ref_a"), F.lit(0.7).alias("ref_b"))
    assert same.select(quality.distance(("a", "b"))).first()[0] < 1e-7


def test_main_path_has_no_python(spark, documents):
    plan = quality.measured(documents([(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan

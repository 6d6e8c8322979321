"""Licence scan against containment by brute force."""

import random

import pytest

from solvenza.llm import licenses

from .conftest import EDGES


def plain(rows):
    sets = {n: set(licenses.shingles(licenses.words_of(t))) for n, t in licenses.TEMPLATES.items()}
    out = []
    for doc_id, text in rows:
        own = set(licenses.shingles(licenses.words_of(text)))
        out += [(doc_id, n) for n, s in sets.items() if len(s & own) >= licenses.CONTAINED * len(s)]
    return sorted(out, key=str)


def rows():
    rng = random.Random(6)
    filler = lambda n: " ".join("".join(rng.choices("abcdefg", k=5)) for _ in range(n))
    out = []
    for i, (name, text) in enumerate(licenses.TEMPLATES.items()):
        words = text.split()
        out.append((10 * i, f"{filler(30)}\n{text}\n{filler(40)}"))
        out.append((10 * i + 1, text.upper().replace(" ", "  \n")))
        if len(words) > 40:  # one word changed leaves more than 0.8
            words[len(words) // 2] = "changed"
            out.append((10 * i + 2, filler(7) + " " + " ".join(words) + " " + filler(3)))
        out.append((10 * i + 3, " ".join(text.split()[: len(text.split()) // 2])))
    return out + [(900 + i, filler(200)) for i in range(20)]


def test_finds_what_containment_finds(documents):
    found = licenses.scanned(documents(rows())).collect()
    assert sorted(((r.doc_id, r.license) for r in found), key=str) == plain(rows())
    assert all(r.containment >= licenses.CONTAINED and r.end_word > r.first_word for r in found)


def test_edges(documents):
    notice = licenses.TEMPLATES["MIT (line)"]
    twice = [(None, notice), (3, notice), (3, notice)]
    found = licenses.scanned(documents(EDGES + twice)).collect()
    assert sorted((r.doc_id or 0, r.license) for r in found) == [(0, "MIT (line)"), (3, "MIT (line)"), (3, "MIT (line)")]
    assert licenses.scanned(documents([])).collect() == []


def test_templates_need_a_shingle(documents):
    with pytest.raises(ValueError):
        licenses.Scanner({"x": "too short"})


def test_bands_meet_at_the_similarity_asked_for():
    """Windows of Jaccard 0.8 collide in nearly all draws."""
    rng, met = random.Random(8), 0
    scan = licenses.Scanner({"t": " ".join(f"w{i}" for i in range(60))})
    words = [f"w{i}" for i in range(22, 22 + licenses.LARGEST + licenses.SHINGLE - 1)]
    for _ in range(200):
        cut = rng.randint(0, 3)
        near = words[cut:] + [f"x{rng.random()}" for _ in range(cut)]
        met += bool(scan.candidates(scan.hashed(near)))
    assert met >= 198

"""Patterns against plain regular expressions; terms that reveal an entity."""

import hashlib
import random
import re

import pytest

from solvenza.llm import pii

from .conftest import EDGES


def plain(text):
    text, found = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 12 <= len(digits) <= 19 and pii.luhn(digits):
            found.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


@pytest.mark.parametrize("letters", ["ab.1@- é", "0123456789. -+()", "a@.b%+1-", "1.2@+ -"])
def test_patterns(letters):
    rng = random.Random(4)
    for _ in range(5000):
        text = "".join(rng.choices(letters, k=rng.randint(1, 40)))
        assert pii.base_spans(text) == plain(text), text


@pytest.mark.parametrize("digits,valid", [("4111111111111111", True), ("4111111111111112", False), ("000000000000", True)])
def test_luhn(digits, valid):
    assert pii.luhn(digits) is valid


@pytest.mark.parametrize("text", ["1" * 200_000, "a" * 200_000 + "@", "@" * 100_000, "0" * 6000 + "1.1.1.1", "+1((" * 50_000])
def test_long_runs_take_linear_time(text):
    assert len(pii.base_spans(text)) <= 1


SECRET = [
    (i, f"Report {w} number. Contact Zyxwald at joe{1}@mail.example about {w} matters today")
    for i, w in enumerate(["spring", "summer", "autumn", "winter", "monsoon"])
]
OTHER = [(100 + i, f"contact people about matters today in week {i} and report the number") for i in range(60)]


@pytest.mark.parametrize("bits", [pii.BITS, 8])
def test_terms_that_reveal_an_entity(documents, bits):
    found = {r.doc_id: r for r in pii.detected(documents(SECRET + OTHER), bits).collect()}
    for doc_id, text in SECRET:
        r = found[doc_id]
        at = text.index("Zyxwald")
        assert f"term:{at}:{at + 7}" in r.spans and r.n_email == 1 and pii.spelled(plain(text)) in r.spans
        assert all(text[a.start:a.end].lower() in ("zyxwald", "mail", "joe1") for a in r.added)
    assert all(found[i].spans == "" for i, _ in OTHER)


def test_copies_of_one_text_reveal_nothing(documents):
    copies = [(i, SECRET[0][1]) for i in range(9)]
    found = pii.detected(documents(copies + OTHER)).collect()
    assert not any("term" in r.spans for r in found)


@pytest.mark.parametrize("bits", [pii.BITS, 8])
def test_a_revealing_term_is_masked_wherever_it_stands(documents, bits):
    far = "plain words in week\n" * 30
    rows = [(i, f"{w} letter. Write to ann@mail.example about {w}\n{far}Quorvex agreed, quorvex said")
            for i, w in enumerate(["red", "green", "blue", "white", "black", "brown"])]
    rows += [(50, "plain words but Quorvex"), (51, None), *((100 + i, f"plain words in week {i}") for i in range(400))]
    texts = {r.doc_id: r.text for r in pii.sanitised(documents(rows + rows[:1]), bits).collect()}
    assert all("uorvex" not in (texts[i] or "") for i in (*range(6), 50))
    assert texts[50] == "plain words but [NAME]" and far in texts[0]
    assert all(texts[i] == t for i, t in rows if i > 50)


def test_an_entity_with_two_mentions_is_judged(documents):
    rows = [(1, "Ask Brimvoll soon: 10.20.30.40 is up"), (2, "On 10.20.30.40 runs what Brimvoll made, they say")]
    rows += [(100 + i, f"ask them soon on what they say is up number {i}") for i in range(400)]
    found = {r.doc_id: r for r in pii.detected(documents(rows)).collect()}
    named = {i: {t[a.start:a.end] for a in found[i].added} for i, t in rows[:2]}
    assert all("Brimvoll" in n for n in named.values())
    assert not any(n & {"Ask", "ask", "soon", "what", "they", "say"} for n in named.values())
    assert all(found[i].spans == "" for i, _ in rows[2:])


def test_sanitised(documents):
    docs = documents(SECRET + OTHER + [(900, None), (901, "")])
    out = pii.sanitised(docs)
    assert out.columns == docs.columns
    texts = {r.doc_id: r.text for r in out.collect()}
    assert all("Zyxwald" not in texts[i] and "[EMAIL]" in texts[i] for i, _ in SECRET)
    assert all(texts[i] == t for i, t in OTHER) and texts[900] is None and texts[901] == ""


def test_overlapping_spans_and_kinds():
    text = "Bob 7 bob +1 (212) 555-0100"
    added = [{"start": 0, "end": 3, "action": "generalise"}, {"start": 4, "end": 5, "action": "generalise"},
             {"start": 6, "end": 9, "action": "remove"}]
    assert pii.masked(text, added) == "[NAME] [NUMBER]  [PHONE]"


def test_edges(documents):
    found = pii.detected(documents(EDGES)).collect()
    assert len(found) == len(EDGES)
    assert all(r.spans == "" and r.base_sha256 == hashlib.sha256(b"").hexdigest() for r in found)
    assert pii.detected(documents([])).collect() == []
    assert pii.sanitised(documents([])).collect() == []


def plain_terms(rows):
    """{term: action} by counting in sets, with the module's limits."""
    from collections import defaultdict
    from math import log, sqrt

    n, docs = len(rows), {}
    for i, (_, text) in enumerate(rows):
        text = text or ""
        spans = pii.base_spans(text)
        known, beside = pii.entities(text, spans) if spans else ([], {})
        terms = {t: (a, b) for t, a, b in pii.places(text, spans)}
        words = sum(len(a) for a, _ in terms.values())
        docs[i] = (dict(known), terms, beside, len(beside) / max(1, words))
    of_entity, of_term = defaultdict(set), defaultdict(set)
    for i, (known, terms, _, _) in docs.items():
        for e in known:
            of_entity[e].add(i)
    for i, (_, text) in enumerate(rows):
        for t in set(map(pii.named, pii._TERM.findall(text or ""))):
            of_term[t].add(i)
    inside = defaultdict(set)
    for i, (known, terms, _, _) in docs.items():
        if known:
            for t in terms:
                inside[t].add(i)
    out = {}
    smallest = {}
    for e in sorted(of_entity, reverse=True):
        smallest[frozenset(of_entity[e])] = e
    for t, where in inside.items():
        n_t, shares, alone = len(of_term[t]), [], False
        by_chance = max(docs[i][3] for i in where) > pii.BY_CHANCE
        near = all(any(a in docs[i][2] for a in docs[i][1][t][0]) for i in where)
        for e in smallest.values():
            both, n_e = where & of_entity[e], len(of_entity[e])
            if not both or n_e >= n or n_t > n_e * (n / n_e) ** (1 - pii.GENERALISE) * (1 + 1e-9):
                continue
            texts = len({docs[i][0][e] for i in both})
            if texts > 1:
                p, z2 = len(both) / n_t, pii.DEVIATIONS ** 2
                m = texts / p
                low = (p + z2 / (2 * m) - sqrt(z2 * (p * (1 - p) / m + z2 / (4 * m * m)))) / (1 + z2 / m)
                shares.append(1 + log(low) / log(n / n_e))
            alone |= texts == 1 and len(both) == n_t
        share = max(shares, default=0)
        if share >= pii.GENERALISE or (alone and near and not by_chance):
            out[t] = "remove" if share >= pii.REMOVE else "generalise"
    return out


def test_counts_and_shares_by_brute_force(documents):
    rng = random.Random(8)
    common = [f"word{i}" for i in range(60)]
    names = [f"Name{i}x" for i in range(30)]
    rows = []
    for i in range(500):
        words = rng.choices(common, k=rng.choice([8, 40, 500]))
        if rng.random() < 0.3:
            entity = rng.randint(0, 11)
            at = rng.randint(0, len(words))
            beside = [names[entity]] if rng.random() < 0.9 else [rng.choice(names)]
            words[at:at] = [f"u{entity}@mail.example", *beside, *([f"once{i}q"] if rng.random() < 0.5 else [])]
            if rng.random() < 0.3:
                words += [f"far{i}q", names[entity]]
        elif rng.random() < 0.03:
            words.append(rng.choice(names))
        rows.append((i, " ".join(words)))
    rows += [(600 + i, rows[3][1]) for i in range(5)] + [(700, None), (701, "z" * 200 + " 1.2.3.4 " + "z" * 200)]
    expected = plain_terms(rows)
    assert {"generalise", "remove"} == set(expected.values()) and any(t.startswith("once") for t in expected)
    assert not any(t.startswith("far") for t in expected)
    got = {}
    for r in pii.detected(documents(rows)).collect():
        text = dict(rows)[r.doc_id] or ""
        for s in r.added or []:
            got[pii.named(text[s.start:s.end])] = s.action
    assert got == expected


def test_lone_words_do_not_depend_on_the_size_of_the_corpus(documents):
    """One word beside an address in a long text is told, others of the text never are."""
    filler = " ".join(f"filler{i}" for i in range(400))
    secret = f"{filler} Quillon ann@mail.example"
    for others in (20, 3000):
        rows = [(1, secret), (2, "short Zed bob@mail.example note")]
        rows += [(10 + i, filler) for i in range(others)]
        found = {r.doc_id: r for r in pii.detected(documents(rows)).collect()}
        assert {secret[s.start:s.end] for s in found[1].added} == {"Quillon"}
        assert not found[2].added


def test_table_holds_its_terms(spark):
    terms = ["a", "é日本", "x" * 64, *(f"t{i}" for i in range(500))]
    df = spark.createDataFrame([(t,) for t in terms], "term string")
    for bits in (8, 1 << 16, pii.BITS):
        table = pii.table_of(df, bits)
        assert all(t in table for t in terms)
    assert sum(f"other{i}" in table for i in range(1000)) < 5

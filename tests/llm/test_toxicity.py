"""Learning from document labels, held-out accuracy, and the sentences found."""

import random
import zlib

import pytest

from solvenza.llm import toxicity

from .conftest import EDGES


def corpus(n, seed):
    rng = random.Random(seed)
    words = [f"word{i}" for i in range(200)]
    rows = []
    for i in range(n):
        sentences = [" ".join(rng.choices(words, k=8)) for _ in range(rng.randint(1, 12))]
        toxic = i % 4 == 0
        if toxic:
            at = rng.randrange(len(sentences))
            sentences[at] += rng.choice([" vile scum", " utter scum", " vile rot"])
        rows.append((i, ". ".join(sentences) + ".", int(toxic)))
    return rows


@pytest.fixture(scope="module")
def fitted(spark):
    rows = corpus(600, 3)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2], 1) for r in rows], "doc_id long, toxic int, text int")
    return rows, docs, toxicity.fit(docs, labels)


def test_held_out_accuracy(spark, fitted):
    rows, docs, model = fitted
    scores = {r.doc_id: r for r in toxicity.scored(docs, model).collect()}
    held = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i, _ in held} == {i for i, r in scores.items() if r.held_out}
    assert sum(scores[i].predicted == y for i, y in held) / len(held) > 0.95


def test_offending_sentences_are_located(fitted):
    rows, _, model = fitted
    text = "word1 word2 word3. word4 vile scum word5. word6 word7."
    score, marked = model.sentences(text)
    assert score >= 0.5
    start, end, p = max(marked, key=lambda m: m[2])
    assert text[start:end].strip() == "word4 vile scum word5" and p >= 0.5


def test_noisy_or(fitted):
    _, _, model = fitted
    one, two = (model.sentences("vile scum." * n)[0] for n in (1, 2))
    assert two == pytest.approx(1 - (1 - one) ** 2)
    assert model.sentences(None)[0] == model.sentences("")[0] == model.sentences("unseen")[0]


def test_edges(documents, fitted):
    _, _, model = fitted
    found = toxicity.scored(documents(EDGES), model).collect()
    assert len(found) == len(EDGES) and all(0 <= r.score <= 1 for r in found)
    assert toxicity.scored(documents([]), model).collect() == []
    docs = documents([(1, "fine words"), (2, "vile scum"), (None, None)])
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {1, None}


@pytest.mark.parametrize("labels", [[], [(1, 0)], [(None, 1), (1, None)]])
def test_nothing_to_learn(spark, documents, labels):
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(documents(EDGES), table)
    assert model.weights == {} and 0 < model.sentences("any")[0] < 1


def test_held_out_rows_are_never_learned_from(spark, fitted):
    rows, docs, model = fitted
    flipped = [(i, (1 - y) if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, _, y in rows]
    assert toxicity.fit(docs, spark.createDataFrame(flipped, "doc_id long, toxic int")) == model


def test_length_is_no_evidence(spark, documents, fitted):
    rows, _, model = fitted
    clean = [s for _, text, y in rows if not y for s in text.split(".") if s]
    long = ". ".join((clean * 10)[:10_000])
    assert long.count(".") == 9_999
    assert model.sentences(long)[0] < 0.5 and model.sentences("plain words. " * 10_000)[0] < 0.5
    # One toxic sentence shows at any length.
    docs = documents([(1, long), (2, long + ". vile scum.")])
    assert [r.doc_id for r in toxicity.without_toxic(docs, model).collect()] == [1]


def test_background_is_taken_off_by_sentence():
    model = toxicity.Model(-3.0, {"rude": 1.0}, background=0.127)
    assert model.sentences("rude. " * 10_000)[0] < 0.5
    assert model.sentences("so rude. " * 6)[0] < toxicity.Model(-3.0, {"rude": 1.0}).sentences("so rude. " * 6)[0]


@pytest.mark.parametrize("labels", [[], [(1, 0)], [(1, 1), (4, 1)]])
def test_where_nothing_is_learned_nothing_goes(spark, documents, labels):
    docs = documents([*EDGES, (50, "plain. words. " * 500)])
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert toxicity.without_toxic(docs, model).count() == docs.count()


def test_texts_that_do_not_fit_the_sample_are_skipped(spark):
    rows = corpus(600, 5)
    size = sum(len(text) for _, text, _ in rows)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    order = labels.filter(~toxicity.held_out()).selectExpr("doc_id", "xxhash64(cast(doc_id as string)) AS o")
    first, second = [r.doc_id for r in order.orderBy("o").limit(2).collect()]
    texts = {i: text for i, text, _ in rows} | {first: "long " * size, second: "x" * (size // 2)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    model = toxicity.fit(docs, labels, size=size)
    assert {"scum", "vile"} <= model.weights.keys()
    assert model.sentences("vile scum")[0] > 0.5 > model.sentences("word1 word2")[0]

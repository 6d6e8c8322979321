"""Toxic documents by multiple-instance learning over their sentences.

Only documents are labelled. A sentence has the probability ``sigmoid(bias + weights
of its words)``, a document the noisy-or of its sentences: it is toxic unless every
sentence is clean. The likelihood of the document labels under that rule trains the
sentence model, which then tells which sentences offend.

Length is no evidence. In a score only sentences with a word that speaks for toxicity
count, and what sentences of clean labelled texts give on average is taken off for each
sentence. A score is never below that of the worst sentence.

The model is fitted on the driver from a bounded sample of labelled rows: at most
``SAMPLE_ROWS`` rows and ``SAMPLE_BYTES`` of text, the first by a hash of doc_id. All
documents are scored, whole, in tasks that share nothing but the model.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from solvenza.llm.common import map_rows

SAMPLE_ROWS = 6000
SAMPLE_BYTES = 20 << 20
SHARE = 100
FOLDS, HELD_OUT = 5, 0      # crc32 of doc_id modulo FOLDS; the fold HELD_OUT is never learned from
LEAST_ROWS = 5              # sampled documents that hold a word of the model
LEAST_Z = 2.5               # standard errors between its rates in toxic and other documents
MOST_WORDS = 4096
STEPS, RATE, SPARSITY = 300, 0.1, 2e-4
THRESHOLD = 0.5
LEAST = 1e-9                # score of a text without evidence

_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"\w+")


@dataclass
class Model:
    bias: float
    weights: dict[str, float] = field(default_factory=dict)
    background: float = 0.0     # evidence of a sentence of a clean text, on average

    def _evidence(self, text: str | None) -> tuple[int, float, list[tuple[int, int, float]]]:
        """How many sentences a text has, their evidence (the negative log probability
        that those with evidence are clean), and (start, end, probability) of the
        sentences that have a word of the model."""
        marked, n, evidence = [], 0, 0.0
        weights, known = self.weights, self.weights.keys()
        for found in _SENTENCE.finditer(text or ""):
            n += 1
            words = _WORD.findall(found[0].lower())
            if known.isdisjoint(words):
                continue
            z = self.bias + sum(map(weights.__getitem__, known & words))
            if z > self.bias:
                evidence += np.logaddexp(0.0, z)
            marked.append((found.start(), found.end(), float(1 / (1 + np.exp(-z)))))
        return n, evidence, marked

    def sentences(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        """A text's probability, and (start, end, probability) of the sentences that
        have a word of the model. A text without evidence has the probability ``LEAST``."""
        n, evidence, marked = self._evidence(text)
        worst = max((p for *_, p in marked), default=0.0) if evidence else 0.0
        return max(LEAST, worst, float(-np.expm1(n * self.background - evidence))), marked


def _sentences(text: str | None) -> list[set[str]]:
    return [set(_WORD.findall(s.lower())) for s in _SENTENCE.findall(text or "")] or [set()]


def _vocabulary(texts: list[str | None], toxic: np.ndarray) -> list[str]:
    """Words whose rate in toxic documents differs clearly from that in the others.
    Only words of toxic documents are held."""
    inside, outside = Counter(), Counter()
    for text, label in zip(texts, toxic):
        if label:
            inside.update(set().union(*_sentences(text)))
    for text, label in zip(texts, toxic):
        if not label:
            outside.update(inside.keys() & set().union(*_sentences(text)))
    a, b = toxic.sum(), (1 - toxic).sum()
    clear = []
    for word, n in inside.items():
        m = outside[word]
        rate = (n + m) / (a + b)
        error = np.sqrt(rate * (1 - rate) * (1 / a + 1 / b))
        z = abs(n / a - m / b) / error if error else 0.0
        if n + m >= LEAST_ROWS and z >= LEAST_Z:
            clear.append((-z, word))
    return [word for _, word in sorted(clear)[:MOST_WORDS]]


def train(texts: list[str | None], labels: list[int]) -> Model:
    """Maximum likelihood of the document labels under noisy-or, with sparse weights.

    Without rows of both classes the model has the smoothed rate of label 1 and no words,
    so that it finds no evidence in any text.
    """
    toxic = np.array(labels, float)
    prior = (toxic.sum() + 1) / (len(toxic) + 2)
    if not 0 < toxic.sum() < len(toxic):
        return Model(float(np.log(prior / (1 - prior))))
    words = _vocabulary(texts, toxic)
    place = {w: i for i, w in enumerate(words)}
    # One entry per (sentence, word of the vocabulary); sentences without one count only.
    docs, sizes = range(len(texts)), np.zeros(len(texts))
    of_doc, rows, columns, plain = array("q"), array("q"), array("q"), np.zeros(len(texts))
    for d, text in enumerate(texts):
        for s in _sentences(text):
            sizes[d] += 1
            found = place.keys() & s
            if found:
                rows.extend([len(of_doc)] * len(found))
                columns.extend(sorted(place[w] for w in found))
                of_doc.append(d)
            else:
                plain[d] += 1
    of_doc, rows, columns = (np.array(x, np.int64) for x in (of_doc, rows, columns))
    # theta[0] is the bias, a low one at first: most sentences are clean.
    theta = np.concatenate([[np.log(prior / max(1.0, sizes.mean()))], np.zeros(len(words))])
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        z = theta[0] + np.bincount(rows, theta[1:][columns], len(of_doc))
        p, base = 1 / (1 + np.exp(-z)), 1 / (1 + np.exp(-theta[0]))
        clean = plain * -np.logaddexp(0, theta[0]) - np.bincount(of_doc, np.logaddexp(0, z), len(docs))
        # d(-log likelihood)/d(clean) is 1 - y / P(toxic), and d(clean)/dz is -p.
        outer = (toxic / np.maximum(-np.expm1(clean), 1e-6) - 1) / len(docs)
        per_sentence = -outer[of_doc] * p
        grad = np.concatenate([
            [per_sentence.sum() - (outer * plain).sum() * base],
            np.bincount(columns, per_sentence[rows], len(words)),
        ])
        mean, square = 0.9 * mean + 0.1 * grad, 0.99 * square + 0.01 * grad ** 2
        rate = RATE * min(1.0, 3 * (1 - step / (STEPS + 1)))
        scale = np.sqrt(square / (1 - 0.99 ** step)) + 1e-8
        theta = theta - rate * mean / (1 - 0.9 ** step) / scale
        shrink = rate * SPARSITY / scale[1:]
        theta[1:] = np.sign(theta[1:]) * np.maximum(np.abs(theta[1:]) - shrink, 0)
    model = Model(float(theta[0]), {w: float(v) for w, v in zip(words, theta[1:]) if v})
    clean = [model._evidence(text)[:2] for text, label in zip(texts, labels) if not label]
    model.background = float(sum(e for _, e in clean) / max(1, sum(n for n, _ in clean)))
    return model


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Whether a row is never learned from; a NULL id counts as empty text."""
    text = (F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string")
    return F.crc32(F.coalesce(text, F.lit(""))) % FOLDS == HELD_OUT


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES) -> Model:
    """Learns from labelled documents outside the held-out fold.

    Rows without a label, text or id teach nothing. Repeated rows count as often as they
    occur. An id that does not fit the bound any more is left out, not those after it; ids
    with more than a ``SHARE``-th of the bytes come last, so that none displaces many. Only doc_id and toxic of the labels, doc_id and text of the
    documents are read.
    """
    usable = labels.select("doc_id", "toxic").dropna().filter(~held_out())
    order = F.xxhash64(F.col("doc_id").cast("string"))
    first = usable.orderBy(order, "doc_id", "toxic").limit(rows)
    # At most ``rows`` ids, so they can go to every task.
    chosen = docs.select("doc_id", "text").dropna().join(F.broadcast(first), "doc_id")
    sized = chosen.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("text")).alias("n")
    )
    sized = sized.withColumn("large", F.col("n") * SHARE > size)
    taken, left, room = set(), rows, size
    for r in sized.orderBy("large", order, "doc_id").collect():
        if r.rows <= left and r.n <= room:
            taken.add(r.doc_id)
            left, room = left - r.rows, room - r.n
    if not taken:
        return train([], [])
    ids = docs.sparkSession.createDataFrame([(i,) for i in taken], docs.select("doc_id").schema)
    found = chosen.join(F.broadcast(ids), "doc_id").collect()
    found.sort(key=lambda r: (r.doc_id, r.toxic, r.text))
    return train([r.text for r in found], [int(r.toxic) for r in found])


def scored(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted and offending sentences of every document.

    ``offending`` has start, end (code points, end exclusive) and score of each sentence
    at or over the threshold. NULL, empty and blank texts have the score of one sentence
    without words. A NULL or repeated doc_id is handed on, and a NULL id hashes as empty
    text. Only doc_id and text are read; an empty table gives an empty result.
    """
    def rows(batches: Iterator[list[list]]) -> Iterator[tuple]:
        for doc_ids, held, texts in batches:
            for doc_id, out, text in zip(doc_ids, held, texts):
                score, marked = model.sentences(text)
                offending = [m for m in marked if m[2] >= threshold]
                yield doc_id, out, score, int(score >= threshold), offending

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = (
        f"doc_id {kind}, held_out boolean, score double, predicted int, "
        "offending array<struct<start: int, end: int, score: double>>"
    )
    return map_rows(docs.select("doc_id", held_out().alias("held_out"), "text"), schema, rows)


def without_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows and columns of ``docs`` whose text scores below the threshold."""
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(place).to_pylist()
            yield batch.filter(pa.array([model.sentences(t)[0] < threshold for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

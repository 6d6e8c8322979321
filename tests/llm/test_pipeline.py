"""The stages: planted cases go, clean documents stay, columns are kept."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from solvenza.llm import pii
from solvenza.llm.packing import token_ids
from solvenza.llm.simhash import fingerprint
from solvenza.llm.suffixes import runs
from solvenza.llm.tokens import read_spec

FOLDER = "/root/testdata/sf0.001"


def test_queries_are_registered():
    names = entry.queries()
    assert [n for n in (f"op{i}_" for i in range(1, 14)) if not any(q.startswith(n) for q in names)] == []
    assert "pipeline" in names and len(pipeline.STAGES) == 5


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output of every stage over the small table."""
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), {}
    for name, stage in pipeline.STAGES:
        from solvenza.llm.common import written
        made = written(stage(spark, docs, FOLDER), f"test-{name}")
        out[name] = (docs, made)
        docs = made
    return out


def test_columns(stages):
    for name, (before, after) in stages.items():
        if name != "packing":
            assert after.dtypes == before.dtypes


def test_toxicity_keeps_clean_documents(stages, spark):
    before, after = stages["toxicity"]
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").filter("toxic = 0")
    clean = before.join(labels, "doc_id").select("doc_id").distinct()
    lost = clean.join(after, "doc_id", "left_anti").count()
    assert lost <= 0.1 * clean.count()
    assert before.join(after, "doc_id", "left_anti").count() > 0


def test_near_duplicates_keep_one_of_each_group(stages):
    before, after = ([(r.doc_id, fingerprint(r.text)) for r in d.collect()] for d in stages["near_duplicates"])
    fps = np.array([f for _, f in after])
    for i in range(len(fps)):
        assert (np.bitwise_count((fps[i + 1:] ^ fps[i]).view(np.uint64)) > 3).all()
    kept = {i for i, _ in after}
    for doc_id, fp in before:   # what went is linked with something
        if doc_id not in kept:
            assert any(bin((fp ^ f) & (1 << 64) - 1).count("1") <= 3 for i, f in before if i != doc_id)


def test_passages_stay_once(stages):
    before, after = ({r.doc_id: r for r in d.collect()} for d in stages["passages"])
    seen, size = set(), pipeline.PASSAGE
    for doc_id in sorted(before):
        data = (before[doc_id].text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - size + 1):
            if data[i:i + size] in seen:
                gone[i:i + size] = b"\1" * size
            seen.add(data[i:i + size])
        for a, b in runs(np.frombuffer(bytes(gone), np.uint8) > 0):
            if len(data[a:b].split()) < pipeline.PASSAGE_WORDS:
                gone[a:b] = bytes(b - a)
        kept = bytes(x for x, g in zip(data, gone) if not g).decode("utf-8", "ignore")
        assert after[doc_id].text == kept and after[doc_id].n_chars == len(kept)


def test_personal_data_is_gone(stages):
    before, after = ({r.doc_id: r.text for r in d.collect()} for d in stages["personal_data"])
    assert before.keys() == after.keys()
    for doc_id, text in before.items():
        if not pii.base_spans(text):
            assert after[doc_id] == text
        else:
            assert after[doc_id] != text and not any(k == 0 for _, k, _ in pii.base_spans(after[doc_id]))


def test_packing_holds_every_token(stages):
    before, after = stages["packing"]
    spec = read_spec(pipeline.VOCABULARY)
    expected = {r.doc_id: len(token_ids(r.text, spec)) // 4 + 1 for r in before.collect()}
    found = {r.doc_id: r.n for r in after.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert found == expected


@pytest.mark.parametrize("position", range(5))
def test_stages_take_nulls_repeats_and_nothing(spark, position):
    schema = spark.read.parquet(f"{FOLDER}/documents.parquet").schema
    clashing = ("kept", "removed", "repeats", "added", "_own", "_own_key", "key", "windows", "w")
    rng = random.Random(position)
    text = " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(80))
    rows = [(1, text, "en", "s", 1), (1, text, "en", "s", 1), (2, None, None, None, None), (None, "x", "en", "s", 1),
            (None, None, None, None, None), (3, "", "en", "s", 0)]
    _, stage = pipeline.STAGES[position]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        made = stage(spark, docs, FOLDER).collect()
        assert bool(made) == bool(data)
    for name in clashing:
        docs = docs.withColumn(name, F.lit(name))
    made = stage(spark, spark.createDataFrame([(*r, *clashing) for r in rows], docs.schema), FOLDER)
    assert made.count() > 0
    if position < 4:
        assert made.columns == docs.columns and {tuple(r)[5:] for r in made.collect()} == {clashing}

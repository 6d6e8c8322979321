"""Stages that turn raw documents into packed training sequences.

Each stage takes (spark, docs, sf_dir), works on all rows the one before it kept, and
returns the columns of ``documents``; the last returns pieces of packed sequences. Texts
that a stage changes get a new ``n_chars``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from solvenza.llm import packing, pii, simhash, suffixes, toxicity
from solvenza.llm.common import read_table, ship, written
from solvenza.llm.queries import VOCABULARY

# Words of a passage whose later copies go, and the bytes that so many have at least.
PASSAGE_WORDS = 51
PASSAGE = 2 * PASSAGE_WORDS - 1


def _counted(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.char_length("text").cast(kind))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that the sentence model, fitted on the labels, calls toxic."""
    ship(spark)
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked SimHash fingerprints."""
    ship(spark)
    return simhash.representatives(docs)


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without later copies of passages; a text that only repeats others becomes empty."""
    ship(spark)
    return _counted(suffixes.without_repeats(docs, PASSAGE, "first", PASSAGE_WORDS))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With personal data named by kind, and terms that reveal it generalised or removed."""
    ship(spark)
    return _counted(pii.sanitised(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return packing.packed(docs, VOCABULARY)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("passages", cut_passages),
    ("personal_data", mask_personal_data),
    ("packing", pack),
]
# A trained model and tokenizers have no SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

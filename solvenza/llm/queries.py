"""One query per operator, over its whole table with production parameters."""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from solvenza.llm import (
    debruijn, divergence, licenses, neighbours, packing, pii, quality, simhash, suffixes, tokens, toxicity, warc,
    whitening,
)
from solvenza.llm.common import read_table, ship

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def query(fn: Query) -> Query:
    @functools.wraps(fn)
    def run(spark: SparkSession, root: str) -> DataFrame:
        ship(spark)
        return fn(spark, root)

    _QUERIES[fn.__name__] = run
    return run


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


@query
def op1_warc(spark, root):
    return warc.round_trip(read_table(spark, root, "pages")).drop("target_uri")


@query
def op2_quality(spark, root):
    judged = quality.judged(read_table(spark, root, "documents"))
    return judged.drop("chars_distance", "words_distance")


@query
def op3_bpe(spark, root):
    return tokens.encoded(read_table(spark, root, "documents"), VOCABULARY)


@query
def op4_toxicity(spark, root):
    docs = read_table(spark, root, "documents")
    model = toxicity.fit(docs, read_table(spark, root, "labels"))
    return toxicity.scored(docs, model).withColumn("n_offending", F.size("offending")).drop("offending")


@query
def op5_packing(spark, root):
    return packing.packed(read_table(spark, root, "documents"), VOCABULARY)


@query
def op6_nn_descent(spark, root):
    return neighbours.nearest_neighbours(read_table(spark, root, "embeddings"), F.col("vec_id") % 50 == 0)


@query
def op7_suffix_array(spark, root):
    cut = suffixes.deduplicated(read_table(spark, root, "documents").select("doc_id", "text"))
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return cut.select(
        "doc_id", n_bytes.alias("n_bytes"), (n_bytes - F.octet_length("kept")).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
        (F.size("removed") > 0).alias("has_repeats"),
    )


@query
def op8_pii(spark, root):
    return pii.detected(read_table(spark, root, "documents")).drop("base", "added")


@query
def op9_licenses(spark, root):
    return licenses.scanned(read_table(spark, root, "documents"))


@query
def op10_simhash(spark, root):
    found = simhash.near_duplicates(read_table(spark, root, "documents"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


@query
def op11_divergence(spark, root):
    return divergence.audited(read_table(spark, root, "documents"))


@query
def op12_whitening(spark, root):
    return whitening.whitened(read_table(spark, root, "embeddings").select("vec_id", "embedding")).drop("embedding")


@query
def op13_debruijn(spark, root):
    cut = debruijn.deduplicated(read_table(spark, root, "documents").select("doc_id", "text"), with_spans=False)
    return cut.select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"),
        (F.col("n_removed") > 0).alias("has_repeats"),
    )

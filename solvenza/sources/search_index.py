"""A stored index of company names by character sequence.

A posting list holds the companies whose lower-case name has a sequence of one to three
characters. Lists are written in ``BUCKETS`` folders by a hash of the sequence, so a
search opens those of its own sequences only and never the catalog. A later batch of names
adds lists to the folders; a sequence then has several, as has one that more than
``LIST_ROWS`` names of a batch share. What is kept of a sequence beside its lists is how
many companies they hold, in a column that is read without them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from solvenza.functions import scalars as S
from solvenza.session import spread, written

LONGEST = 3
BUCKETS = 64
LIST_ROWS = 20_000
SCHEMA = "gram STRING, n BIGINT, companies ARRAY<STRUCT<name: STRING, industry: STRING>>, bucket INT"


def grams(text: Column, size: Column) -> Column:
    return F.transform(
        F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: F.substring(text, i, size)
    )


def _all_grams(text: Column) -> Column:
    none = F.array().cast("array<string>")
    sizes = [F.when(F.length(text) >= n, grams(text, F.lit(n))).otherwise(none) for n in range(1, LONGEST + 1)]
    return F.array_distinct(F.concat(*sizes))


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def extend(names: DataFrame, path: str) -> None:
    """Add (name, industry) rows to the index below ``path``; new ones, each once."""
    names = spread(names.select("name", "industry"))
    rows = names.select("name", "industry", F.explode(_all_grams(F.lower("name"))).alias("gram"))
    counts = rows.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    # A sequence of very many names has several lists, dealt by name. These sequences are
    # few, in a table whose size is known, so the join with them shuffles no names.
    often = counts.filter(F.col("n") > LIST_ROWS).select("gram", F.ceil(F.col("n") / LIST_ROWS).alias("lists"))
    often = written(often, "search-often")
    dealt = rows.join(often, "gram", "left").withColumn(
        "list", F.pmod(F.xxhash64("name"), F.coalesce("lists", F.lit(1))))
    lists = dealt.groupBy("gram", "list").agg(F.collect_list(F.struct("name", "industry")).alias("companies"))
    stored = lists.select(
        "gram", F.size("companies").cast("bigint").alias("n"), "companies", _bucket(F.col("gram")).alias("bucket"))
    stored.repartition(BUCKETS, "bucket").sortWithinPartitions("bucket", "gram").write.mode("append") \
        .partitionBy("bucket").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def search(index: DataFrame, query: str) -> DataFrame:
    """(name, industry) of the companies that ``catalog.search`` finds: those in the lists
    of all sequences of the query, checked against the whole of it."""
    spark = index.sparkSession
    if spark.range(1).select(S.is_blank(F.lit(query))).first()[0]:
        return index.limit(0).select(F.inline("companies"))
    needle = spark.range(1).select(F.lower(F.lit(query))).first()[0]
    size = min(len(needle), LONGEST)
    asked = sorted({needle[i: i + size] for i in range(len(needle) - size + 1)})
    buckets = spark.createDataFrame([(g,) for g in asked], "gram STRING").select(_bucket(F.col("gram")).alias("b"))
    lists = index.filter(F.col("bucket").isin([r.b for r in buckets.distinct().collect()]) & F.col("gram").isin(asked))
    found = lists.select("gram", F.inline("companies")).filter(F.contains(F.lower("name"), F.lit(needle)))
    return found.groupBy("name", "industry").agg(F.count(F.lit(1)).alias("_n")).filter(
        F.col("_n") == len(asked)).drop("_n")


def search_bulk(index: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, name) of all that ``search`` finds for each term, by equi-joins.

    A term is looked up under the sequence of it that the fewest companies have, which the
    counts tell; its lists are then read, and each name in them checked.
    """
    wanted = terms.filter(~S.is_blank(F.col("term"))).select("term").distinct()
    wanted = wanted.withColumn("_needle", F.lower("term"))
    size = F.least(F.length("_needle"), F.lit(LONGEST))
    asked = wanted.select("*", F.explode(F.array_distinct(grams(F.col("_needle"), size))).alias("gram"))
    asked = asked.withColumn("bucket", _bucket(F.col("gram")))
    counts = index.groupBy("gram", "bucket").agg(F.sum("n").alias("_n"))
    rarest = (
        asked.join(counts, ["gram", "bucket"])
        .groupBy("term", "_needle")
        .agg(F.count(F.lit(1)).alias("_known"), F.min_by("gram", F.struct("_n", "gram")).alias("gram"))
    )
    # A sequence that no name has ends the search of its term.
    every = F.size(F.array_distinct(grams(F.col("_needle"), size)))
    rarest = rarest.filter(F.col("_known") == every).withColumn("bucket", _bucket(F.col("gram")))
    return (
        index.join(rarest, ["bucket", "gram"])
        .select("term", "_needle", F.explode("companies.name").alias("name"))
        .filter(F.contains(F.lower("name"), "_needle"))
        .select("term", "name")
    )

"""Service responses kept as JSON text, parsed into rows.

Each reader takes a frame with a ``body`` column of response texts. NULL, an absent
field and the text ``-`` all become NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from solvenza.functions import scalars as S
from solvenza.schemas import CREDIT_RESPONSE, METRICS_RESPONSE, NEWS_RESPONSE, NONFINANCIAL_RESPONSE

SOURCES = "metrics", "rating", "news", "score"


def readable(responses: DataFrame) -> DataFrame:
    """The responses whose body is JSON, with the parsed body as ``parsed``, a VARIANT."""
    return responses.withColumn("parsed", F.try_parse_json("body")).filter("parsed IS NOT NULL")


def unreadable(responses: DataFrame) -> DataFrame:
    """The responses to look into: a body that is missing or cut off, and why."""
    broken = responses.filter(F.try_parse_json("body").isNull())
    reason = F.when(F.col("body").isNull(), "missing").when(F.trim("body") == "", "empty").otherwise("not JSON")
    return broken.withColumn("reason", reason)


def first_record(records: Column) -> Column:
    """The first element, NULL for an empty or missing array."""
    return F.try_element_at(records, F.lit(1))


def metrics(responses: DataFrame) -> DataFrame:
    """One row per metrics record."""
    parsed = responses.select(F.from_json("body", METRICS_RESPONSE).alias("r"))
    return parsed.select(F.inline("r.data"))


def first_metrics(responses: DataFrame) -> DataFrame:
    """Only the first record of each response."""
    parsed = responses.select(F.from_json("body", METRICS_RESPONSE).alias("r"))
    return parsed.select(first_record(F.col("r.data")).alias("m")).filter("m IS NOT NULL").select("m.*")


def credit(responses: DataFrame) -> DataFrame:
    """One row per rated name."""
    parsed = responses.select(F.from_json("body", CREDIT_RESPONSE).alias("r"))
    ratings = parsed.select(F.explode("r.ratings").alias("name", "rating"))
    return ratings.withColumn("rating", F.nullif(F.nullif("rating", F.lit("")), F.lit("-")))


def rating_of(body: Column, name: Column) -> Column:
    """The rating of one name in a response, ``-`` where it has none."""
    return S.map_lookup(F.from_json(body, CREDIT_RESPONSE)["ratings"], name)


def news_blocks(responses: DataFrame) -> DataFrame:
    parsed = responses.select(F.from_json("body", NEWS_RESPONSE).alias("r"))
    return parsed.select(F.inline("r.results"))


def news_articles(responses: DataFrame) -> DataFrame:
    """One row per article of every block."""
    return news_blocks(responses).select(F.col("query").alias("company"), F.inline("items"))


def nonfinancial(responses: DataFrame) -> DataFrame:
    parsed = responses.select(F.from_json("body", NONFINANCIAL_RESPONSE).alias("r"))
    return parsed.select(F.inline("r.results"))


def said(polled: DataFrame) -> DataFrame:
    """(company, source, at, payload): what stored responses of all four services say of
    each company, ``at`` being the poll. A company that a service does not rate or score
    has a NULL payload; records without a company number are left out. Runs on streams.
    """
    metrics, credit, news, scores = (
        F.from_json("body", s) for s in (METRICS_RESPONSE, CREDIT_RESPONSE, NEWS_RESPONSE, NONFINANCIAL_RESPONSE)
    )

    def entry(company: Column, payload: Column) -> Column:
        return F.struct(company.try_cast("bigint").alias("company"), payload.alias("payload"))

    rated = lambda e: F.when(S.or_default(e["value"]) != "-", F.to_json(F.struct(e["value"].alias("rating"))))
    scored = lambda r: F.when(r["score"]["final_score"].isNotNull(), F.to_json(r["score"]))
    entries = {
        "metrics": F.transform(F.slice(metrics["data"], 1, 1), lambda m: entry(m["stock_code"], F.to_json(m))),
        "rating": F.transform(F.map_entries(credit["ratings"]), lambda e: entry(e["key"], rated(e))),
        "news": F.transform(news["results"], lambda r: entry(r["query"], F.to_json(r))),
        "score": F.transform(scores["results"], lambda r: entry(r["company"], scored(r))),
    }
    of = F.when(F.lit(False), entries["metrics"])
    for source, found in entries.items():
        of = of.when(F.col("source") == source, found)
    rows = polled.select("source", F.col("poll").alias("at"), F.explode(of).alias("e"))
    return rows.select("e.company", "source", "at", "e.payload").filter("company IS NOT NULL")


def joined(payloads: DataFrame) -> DataFrame:
    """The columns of all four services from ``payloads``, a map by source."""
    kinds = {
        "metrics": METRICS_RESPONSE.split("ARRAY<", 1)[1][:-1],
        "rating": "STRUCT<rating: STRING>",
        "news": NEWS_RESPONSE.split("ARRAY<", 1)[1][:-1],
        "score": "STRUCT<final_score: DOUBLE>",
    }
    read = [F.from_json(F.col("payloads")[s], kind).alias(s) for s, kind in kinds.items()]
    beside = [c for c in payloads.columns if c != "payloads"]
    return payloads.select(*beside, *read).select(*beside, *[f"{s}.*" for s in kinds])

"""Entities derived from the star-schema and event tables.

Every reader selects its columns before anything else, so the parquet scan reads no
more than the entity needs.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from solvenza.functions import scalars as S
from solvenza.schemas import (
    COLLATERALS, DELINQUENCIES, GRADE_SCALE, PORTFOLIO_RATINGS, RATING_CHANGES,
    RELATIONSHIP_MANAGERS, TABLES,
)


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table under its declared schema, which saves the job that would infer it."""
    return spark.read.schema(TABLES[name]).parquet(os.path.join(root, f"{name}.parquet"))


def _choice(values: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def _customer_name(key: Column) -> Column:
    """The customer table's name of a key; saves orders a join for the name alone."""
    return F.concat(F.lit("Customer#"), F.lpad(key.cast("string"), 9, "0"))


# --- companies --------------------------------------------------------------

def catalog(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "customer").select(
        F.col("c_name").alias("name"), F.col("c_mktsegment").alias("industry"),
        F.lit(None).cast("string").alias("description"),
    )


def companies(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "customer").select(F.col("c_custkey").alias("company"))


def watchlist(spark: SparkSession, root: str) -> DataFrame:
    """Customers that owe money."""
    return table(spark, root, "customer").filter("c_acctbal < 0").select(F.col("c_name").alias("name"))


def add_requests(spark: SparkSession, root: str) -> DataFrame:
    """One request per order for its customer, and one per supplier, which no catalog
    row matches."""
    orders = table(spark, root, "orders").select(
        F.col("o_orderkey").alias("request_id"), F.col("o_orderdate").alias("request_ts"),
        _customer_name(F.col("o_custkey")).alias("name"),
    )
    suppliers = table(spark, root, "supplier").select(
        (-1 - F.col("s_suppkey")).alias("request_id"),
        F.lit("1995-01-01 00:00:00").cast("timestamp_ntz").alias("request_ts"),
        F.col("s_name").alias("name"),
    )
    return orders.unionByName(suppliers)


def small_suppliers(spark: SparkSession, root: str) -> DataFrame:
    """Suppliers with a balance below 5,000."""
    return table(spark, root, "supplier").filter("s_acctbal < 5000").select(F.col("s_suppkey").alias("company"))


def order_years(spark: SparkSession, root: str, first: int) -> DataFrame:
    """The years from ``first`` on in which urgent orders were placed."""
    urgent = F.col("o_orderpriority").startswith("1")
    orders = table(spark, root, "orders").filter(urgent & (F.col("o_orderdate") >= _new_year(first)))
    return orders.select(F.year("o_orderdate").alias("fiscal_year")).distinct()


def search_terms(spark: SparkSession, root: str) -> DataFrame:
    """Part sizes as one- and two-digit terms, and supplier numbers as long ones."""
    sizes = table(spark, root, "part").select(F.col("p_size").cast("string").alias("term"))
    numbers = table(spark, root, "supplier").select(
        F.regexp_replace("s_name", "^Supplier", "OMER").alias("term")
    )
    return sizes.unionByName(numbers).distinct()


def portfolio(spark: SparkSession, root: str) -> DataFrame:
    order, customer = F.col("o_orderkey"), F.col("o_custkey")
    priority = F.substring("o_orderpriority", 1, 1).cast("int")
    status = F.col("o_orderstatus")
    tenths = order % 22
    return table(spark, root, "orders").select(
        _customer_name(customer).alias("name"),
        _choice(PORTFOLIO_RATINGS, priority - 1).alias("rating"),
        F.floor("o_totalprice").alias("loan_amount"),
        F.when(tenths == 21, F.lit(0.0)).otherwise((tenths + 30) / 10.0).alias("interest_rate"),
        F.when(status == "F", DELINQUENCIES[0]).when(status == "O", DELINQUENCIES[1])
        .when(status == "P", DELINQUENCIES[2]).alias("delinquency"),
        _choice(COLLATERALS, customer % 4).alias("collateral"),
        _choice(RELATIONSHIP_MANAGERS, customer % 6).alias("rm"),
        _choice(RATING_CHANGES, order % 3).alias("rating_change"),
    )


def managed_lists(spark: SparkSession, root: str) -> DataFrame:
    """Per nation a stored JSON list of its customers' segments.

    The distinct pairs are made first; a list holds a nation's segments, not its
    customers.
    """
    pairs = table(spark, root, "customer").select("c_nationkey", "c_mktsegment").distinct()
    return pairs.groupBy(F.col("c_nationkey").alias("owner")).agg(
        F.to_json(F.sort_array(F.collect_list("c_mktsegment"))).alias("stored")
    )


def managed_additions(spark: SparkSession, root: str) -> DataFrame:
    """One name per nation to add: its own name, or for even keys a segment it may hold."""
    return table(spark, root, "nation").select(
        F.col("n_nationkey").alias("owner"),
        F.when(F.col("n_nationkey") % 2 == 0, F.lit("BUILDING")).otherwise(F.col("n_name")).alias("name"),
    )


# --- grades and news --------------------------------------------------------

def grade_observations(spark: SparkSession, root: str) -> DataFrame:
    return observations_of(table(spark, root, "events"))


def observations_of(events: DataFrame) -> DataFrame:
    """Grades by event type; errors carry a grade that is not on the scale."""
    kind = F.col("event_type")
    grade = (
        F.when(kind == "view", "AAA").when(kind == "click", "AA").when(kind == "signup", "A+")
        .when(kind == "purchase", "BBB").when(kind == "error", "NR")
    )
    return events.select(
        F.col("user_id").alias("company"), F.col("event_id").alias("id"), "ts",
        grade.alias("grade"), kind.alias("news_keywords"),
    )


def value_observations(spark: SparkSession, root: str) -> DataFrame:
    return values_of(table(spark, root, "events"))


def values_of(events: DataFrame) -> DataFrame:
    """Grades by event value: a series that moves seldom, as a company's grade does."""
    grade = F.when(F.col("value") < 200, "AA").otherwise("BBB")
    return events.select(
        F.col("user_id").alias("company"), F.col("event_id").alias("id"), "ts", grade.alias("grade")
    )


def news_items(spark: SparkSession, root: str) -> DataFrame:
    return items_of(table(spark, root, "events"))


def items_of(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    sentiment = (
        F.when(kind.isin("purchase", "signup"), "positive").when(kind == "error", "negative")
        .otherwise("neutral")
    )
    return events.select(
        F.col("user_id").alias("company"), F.col("event_id").alias("id"), kind.alias("title"),
        F.lit(None).cast("string").alias("link"), F.lit(None).cast("string").alias("press"),
        F.col("ts").alias("published_at"), F.col("props").alias("summary"),
        sentiment.alias("sentiment"),
    )


def latest_event(spark: SparkSession, root: str) -> Column:
    """Time of the last event, as a literal.

    One value, fetched ahead, so that time bounds reach the scan as constants and can
    skip files and row groups.
    """
    last = table(spark, root, "events").agg(F.max("ts").cast("string")).first()[0]
    return F.lit(last).cast("timestamp_ntz")


def read_receipts(spark: SparkSession, root: str) -> DataFrame:
    """Events whose properties hold a ``k`` of 50 or more are read."""
    k = F.get_json_object("props", "$.k").try_cast("int")
    return table(spark, root, "events").filter(k >= 50).select(F.col("event_id").alias("id"))


def links(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "pages").select("page_id", F.col("url").alias("link"))


# --- statements, ratings, scores -------------------------------------------

def _hundredths(amount: str) -> Column:
    return F.rint(F.col(amount) * 100).cast("long")


def _statements(lines: DataFrame, period: Column, name: str) -> DataFrame:
    """Statement lines per supplier and period.

    Sums run over integers of the smallest unit: exact whatever the task order, and
    in fixed-width hash-aggregate buffers that combine before the shuffle.
    """
    price = _hundredths("l_extendedprice")
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")

    def money(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, F.col("_price"))), F.lit(0)) / 100.0

    return (
        lines.select(
            F.col("l_suppkey").alias("company"), period.alias(name), price.alias("_price"),
            (price * _hundredths("l_discount")).alias("_income"),
            (price * _hundredths("l_tax")).alias("_cfo"),
            "l_returnflag", "l_linestatus",
        )
        .groupBy("company", name)
        .agg(
            (F.sum("_price") / 100.0).alias("total_assets"),
            (F.sum("_price") / 100.0).alias("sales"),
            money(flag == "N").alias("equity"),
            money(flag.isin("A", "R")).alias("total_liabilities"),
            money(flag == "R").alias("current_liabilities"),
            money(status == "O").alias("current_assets"),
            money((status == "O") & (flag != "A")).alias("quick_assets"),
            (F.sum("_income") / 10000.0).alias("net_income"),
            (F.sum("_cfo") / 10000.0).alias("cfo"),
        )
    )


def yearly_statements(
    spark: SparkSession, root: str, first_year: int | None = None, last_year: int | None = None
) -> DataFrame:
    """Statements per fiscal year; a year range becomes a date filter in the scan."""
    lines = table(spark, root, "lineitem")
    if first_year is not None:
        lines = lines.filter(F.col("l_shipdate") >= _new_year(first_year))
    if last_year is not None:
        lines = lines.filter(F.col("l_shipdate") < _new_year(last_year + 1))
    return _statements(lines, F.year("l_shipdate"), "fiscal_year")


def _new_year(year: int) -> Column:
    return F.lit(f"{year}-01-01 00:00:00").cast("timestamp_ntz")


def quarterly_statements(spark: SparkSession, root: str) -> DataFrame:
    lines = table(spark, root, "lineitem")
    return _statements(lines, S.quarter_start(F.col("l_shipdate")), "quarter_start")


def public_ratings(spark: SparkSession, root: str) -> DataFrame:
    """Balances banded onto the scale, higher balances better; debtors are unrated."""
    balance = F.col("c_acctbal")
    last = len(GRADE_SCALE) - 1
    band = F.greatest(F.lit(0), F.lit(last) - F.floor(balance / 500)).cast("int")
    return table(spark, root, "customer").select(
        F.col("c_custkey").alias("company"), F.col("c_name").alias("name"),
        F.when(balance >= 0, S.grade_label(band)).alias("rating"),
    )


def nonfinancial(spark: SparkSession, root: str) -> DataFrame:
    """Mean label quality of each document source, nested as a score record."""
    sources = table(spark, root, "documents").select(
        "doc_id", F.regexp_extract("source", r"(\d+)", 1).try_cast("bigint").alias("company")
    )
    labels = table(spark, root, "labels").select("doc_id", "quality")
    return labels.join(sources, "doc_id").groupBy("company").agg(
        F.struct(F.avg("quality").alias("final_score")).alias("score")
    )

"""Loan portfolio: summary and table view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from solvenza.functions import labels, scalars as S
from solvenza.schemas import NO_VALUE


def is_delinquent(status: Column) -> Column:
    return status.isin("연체", "주의")


def is_downgraded(change: Column) -> Column:
    return change == "하락"


def summary(portfolio: DataFrame) -> DataFrame:
    return portfolio.agg(
        F.count(F.lit(1)).alias("n_companies"),
        F.coalesce(F.sum("loan_amount"), F.lit(0)).alias("total_loan"),
        F.count_if(is_delinquent(F.col("delinquency"))).alias("n_delinquent"),
        F.count_if(is_downgraded(F.col("rating_change"))).alias("n_downgraded"),
    ).withColumn("total_loan_text", F.concat(S.thousands(F.col("total_loan")), F.lit("억 원")))


def view(portfolio: DataFrame) -> DataFrame:
    loan, rate = F.col("loan_amount"), F.col("interest_rate")
    return portfolio.select(
        "name", "rating",
        F.when(loan > 0, F.concat(S.thousands(loan), F.lit("억"))).otherwise(NO_VALUE).alias("loan_text"),
        F.when(rate > 0, F.concat(S.plain_number(rate), F.lit("%"))).otherwise(NO_VALUE).alias("rate_text"),
        labels.delinquency_label(F.col("delinquency")).alias("delinquency_label"),
        "collateral", "rm",
        labels.rating_change_label(F.col("rating_change")).alias("rating_change_label"),
    )

"""Financial ratios by year, trends by quarter, market position.

Ratios are fractions: debt ratio is liabilities over equity, current and quick
ratio are over current liabilities, return on assets is net income over total
assets, growth is total assets year on year, and cash flow to debt is operating
cash flow over total liabilities. Windows here run over a company's fiscal years or
quarters after the rows are aggregated to them, so their groups are bounded by the
calendar.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from solvenza.functions import labels, scalars as S
from solvenza.schemas import RATIOS
from solvenza.session import written


def ratios(statements: DataFrame) -> DataFrame:
    """The six ratios per company and fiscal year; growth needs the year before."""
    year_before = Window.partitionBy("company").orderBy("fiscal_year").rangeBetween(-1, -1)
    assets = F.col("total_assets")
    before = F.first("total_assets").over(year_before)
    return statements.select(
        "company", "fiscal_year",
        F.try_divide("total_liabilities", "equity").alias("debt_ratio"),
        F.try_divide("net_income", "total_assets").alias("roa"),
        F.try_divide(assets - before, before).alias("total_asset_growth_rate"),
        F.try_divide("cfo", "total_liabilities").alias("cfo_to_total_debt"),
        F.try_divide("current_assets", "current_liabilities").alias("current_ratio"),
        F.try_divide("quick_assets", "current_liabilities").alias("quick_ratio"),
    )


def latest_period(metrics: DataFrame, period: str = "fiscal_year") -> DataFrame:
    """The last period of every company; the group limit keeps one row per task."""
    newest = Window.partitionBy("company").orderBy(F.desc(period))
    return metrics.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n")


def request_metrics(
    metrics: DataFrame, codes: DataFrame | None = None, all_periods: bool = False,
    percent_format: bool = False,
) -> DataFrame:
    """Metrics of the companies in ``codes``, of the latest period or of all, as
    fractions or as percentage texts."""
    rows = metrics if codes is None else metrics.join(codes.select("company"), "company", "left_semi")
    rows = rows if all_periods else latest_period(rows)
    return displayed(rows) if percent_format else rows


def of_year(metrics: DataFrame, year: int) -> DataFrame:
    return metrics.filter(F.col("fiscal_year") == year)


def displayed(metrics: DataFrame, missing: str = "zero") -> DataFrame:
    return metrics.select(
        "company", "fiscal_year", *[S.to_percentage(F.col(r), missing).alias(r) for r in RATIOS]
    )


def _quarter(quarters: DataFrame) -> Column:
    """Label of the quarter; rows with a true ``is_estimate`` are marked as estimates."""
    estimate = F.col("is_estimate") if "is_estimate" in quarters.columns else None
    return S.quarter_label(F.col("quarter_start"), estimate).alias("quarter")


def quarterly_trend(quarters: DataFrame) -> DataFrame:
    """Profit and cash flow as a percentage of sales by quarter."""
    return quarters.select(
        "company", "quarter_start", _quarter(quarters),
        (F.try_divide("net_income", "sales") * 100).alias("profit"),
        (F.try_divide("cfo", "sales") * 100).alias("cashflow"),
    )


def quarterly_debt_ratio(quarters: DataFrame) -> DataFrame:
    return quarters.select(
        "company", "quarter_start", _quarter(quarters),
        (F.try_divide("total_liabilities", "equity") * 100).alias("ratio"),
    )


def with_dominance(quarters: DataFrame) -> DataFrame:
    """Sales as a percentage of the leader's, and the gap to the best other company.

    The two best companies of a quarter come from a group limit, which every task
    applies before the shuffle. They make one row per quarter, so the table joined
    back is bounded by the calendar and broadcast; no task holds a whole quarter.
    """
    best = Window.partitionBy("quarter_start").orderBy(F.desc("sales"), "company")
    top = (
        quarters.select("quarter_start", "company", "sales")
        .withColumn("_place", F.row_number().over(best))
        .filter("_place <= 2")
        .groupBy("quarter_start")
        .agg(
            F.max(F.when(F.col("_place") == 1, F.col("sales"))).alias("_lead"),
            F.max(F.when(F.col("_place") == 1, F.col("company"))).alias("_leader"),
            F.max(F.when(F.col("_place") == 2, F.col("sales"))).alias("_second"),
        )
    )
    rival = F.when(F.col("company") == F.col("_leader"), F.col("_second")).otherwise(F.col("_lead"))
    index = F.try_divide(F.col("sales") * 100, F.col("_lead"))
    return (
        quarters.join(F.broadcast(top), "quarter_start")
        .withColumn("dominance", index)
        .withColumn("competitor_gap", index - F.try_divide(rival * 100, F.col("_lead")))
        .drop("_lead", "_leader", "_second")
    )


def market_dominance(quarters: DataFrame) -> DataFrame:
    return with_dominance(quarters).select(
        "company", "quarter_start", _quarter(quarters), "dominance", "competitor_gap"
    )


def period_change(series: DataFrame, value: str, lags: dict[str, int] | None = None) -> DataFrame:
    """Point and relative change of ``value`` against the period ``k`` quarters back.

    The frame is a range over consecutive quarter numbers, so a missing quarter
    gives NULL in place of a comparison with the wrong one.
    """
    over = Window.partitionBy("company").orderBy(S.quarter_number(F.col("quarter_start")))
    now = F.col(value)
    changes: list[Column] = []
    for name, k in (lags or {"qoq": 1, "yoy": 4}).items():
        then = F.first(value).over(over.rangeBetween(-k, -k))
        changes += [
            (now - then).alias(f"{name}_points"),
            F.try_divide(now - then, then).alias(f"{name}_rate"),
        ]
    return series.select("company", "quarter_start", value, *changes)


def unpivot(trend: DataFrame, keys: Sequence[str], series: Sequence[str]) -> DataFrame:
    """One row per series and point, for the chosen series."""
    return trend.select(*keys, *series).unpivot(list(keys), list(series), "series", "value")


def risk_indicators(quarters: DataFrame) -> DataFrame:
    """Latest value, change and direction of each company's indicators.

    The quarters are read twice, for the leaders and for all, and are one row per company
    and quarter: they are written, so that the statements are summed up once.
    """
    values = with_dominance(written(quarters, "quarters")).select(
        "company", "quarter_start", _quarter(quarters),
        (F.try_divide("net_income", "sales") * 100).alias("operating_margin"),
        (F.try_divide("total_liabilities", "equity") * 100).alias("debt_ratio"),
        (F.try_divide("current_assets", "current_liabilities") * 100).alias("current_ratio"),
        F.col("dominance").alias("market_confidence"),
    )
    names = ["operating_margin", "debt_ratio", "current_ratio", "market_confidence"]
    by_quarter = Window.partitionBy("company").orderBy(S.quarter_number(F.col("quarter_start")))
    # Changes are taken per company before the indicators become rows, so one
    # shuffle serves all of them.
    measured = values.select(
        "company", "quarter",
        *[
            F.struct(
                F.col(n).alias("value"),
                (F.col(n) - F.first(n).over(by_quarter.rangeBetween(-1, -1))).alias("change_points"),
            ).alias(n)
            for n in names
        ],
        F.lead(F.lit(1)).over(by_quarter).isNull().alias("_latest"),
    ).filter("_latest")
    long = measured.unpivot(["company", "quarter"], names, "indicator", "m")
    change = F.col("m.change_points")
    return long.select(
        "company", "indicator", "quarter",
        F.col("m.value").alias("value"), change.alias("change_points"),
        labels.change_arrow(change).alias("direction"),
    )

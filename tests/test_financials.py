import datetime as dt

import pytest

from solvenza.operators import financials
from solvenza.schemas import METRICS, STATEMENTS

QUARTERS = [dt.date(2024, 1, 1), dt.date(2024, 4, 1), dt.date(2024, 7, 1), dt.date(2024, 10, 1)]
# The trend tables that have to come out.
PROFIT = [6.5, 6.8, 5.5, 5.0]
CASHFLOW = [8.2, 7.9, 6.5, 6.0]
DEBT = [42.1, 44.5, 48.3, 51.2]
NEGATIVE = [15.0, 20.0, 30.0, 45.0]


def quarter_rows(spark, rows):
    return spark.createDataFrame(
        rows,
        "company BIGINT, quarter_start DATE, sales DOUBLE, net_income DOUBLE, cfo DOUBLE, "
        "total_liabilities DOUBLE, equity DOUBLE, current_assets DOUBLE, current_liabilities DOUBLE",
    )


@pytest.fixture(scope="module")
def quarters(spark):
    rows = [
        (1, q, 1000.0, p * 10, c * 10, d, 100.0, 30.0, 20.0 + i)
        for i, (q, p, c, d) in enumerate(zip(QUARTERS, PROFIT, CASHFLOW, DEBT))
    ]
    rows += [(2, q, 800.0, 8.0, 8.0, 50.0, 0.0, 1.0, 1.0) for q in QUARTERS]
    rows += [(3, q, 1000.0, 8.0, 8.0, 50.0, 50.0, 1.0, 1.0) for q in QUARTERS[1:2]]
    return quarter_rows(spark, rows)


def test_trends(quarters):
    rows = financials.quarterly_trend(quarters).filter("company = 1").orderBy("quarter_start").collect()
    assert [r.quarter for r in rows] == ["Q1 2024", "Q2 2024", "Q3 2024", "Q4 2024"]
    assert [r.profit for r in rows] == pytest.approx(PROFIT)
    assert [r.cashflow for r in rows] == pytest.approx(CASHFLOW)
    debt = financials.quarterly_debt_ratio(quarters).orderBy("company", "quarter_start").collect()
    assert [r.ratio for r in debt if r.company == 1] == pytest.approx(DEBT)
    assert [r.ratio for r in debt if r.company == 2] == [None] * 4


def test_estimates_are_marked(quarters):
    marked = quarters.selectExpr("*", "quarter_start = DATE'2024-10-01' AS is_estimate")
    for operator in (
        financials.quarterly_trend, financials.quarterly_debt_ratio, financials.market_dominance,
    ):
        labels = {r.quarter for r in operator(marked).filter("company = 1").collect()}
        assert labels == {"Q1 2024", "Q2 2024", "Q3 2024", "Q4 2024 (E)"}
    assert {r.quarter for r in financials.risk_indicators(marked).filter("company = 1").collect()} == {"Q4 2024 (E)"}


def test_period_change(quarters, spark):
    debt = financials.quarterly_debt_ratio(quarters).filter("company = 1")
    rows = financials.period_change(debt, "ratio").orderBy("quarter_start").collect()
    assert [r.qoq_points for r in rows][1:] == pytest.approx([2.4, 3.8, 2.9])
    assert rows[0].qoq_points is None and all(r.yoy_points is None for r in rows)
    weeks = spark.createDataFrame([(1, q, n) for q, n in zip(QUARTERS, NEGATIVE)], "company BIGINT, quarter_start DATE, n DOUBLE")
    assert financials.period_change(weeks, "n").orderBy("quarter_start").collect()[3].qoq_rate == 0.5


def test_period_change_skips_gaps(spark):
    days = [dt.date(2023, 1, 1), dt.date(2023, 7, 1), dt.date(2024, 1, 1)]
    df = spark.createDataFrame([(1, d, float(i + 1)) for i, d in enumerate(days)], "company BIGINT, quarter_start DATE, v DOUBLE")
    rows = financials.period_change(df, "v").orderBy("quarter_start").collect()
    assert [r.qoq_points for r in rows] == [None, None, None]
    assert [r.yoy_rate for r in rows] == [None, None, 2.0]


def test_dominance(quarters):
    rows = {(r.company, r.quarter): r for r in financials.market_dominance(quarters).collect()}
    assert (rows[1, "Q1 2024"].dominance, rows[1, "Q1 2024"].competitor_gap) == (100.0, 20.0)
    assert (rows[2, "Q1 2024"].dominance, rows[2, "Q1 2024"].competitor_gap) == (80.0, -20.0)
    assert rows[1, "Q2 2024"].competitor_gap == rows[3, "Q2 2024"].competitor_gap == 0.0


def test_dominance_without_rivals(spark):
    df = quarter_rows(spark, [(1, QUARTERS[0], 10.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0)])
    r = financials.market_dominance(df).first()
    assert (r.dominance, r.competitor_gap) == (100.0, None)


def test_risk_indicators(quarters):
    rows = {r.indicator: r for r in financials.risk_indicators(quarters).filter("company = 1").collect()}
    assert len(rows) == 4
    assert rows["debt_ratio"].value == pytest.approx(51.2)
    assert rows["debt_ratio"].change_points == pytest.approx(2.9) and rows["debt_ratio"].direction == "↑"
    assert rows["operating_margin"].direction == rows["current_ratio"].direction == "↓"
    assert rows["market_confidence"].direction == "→"


def test_unpivot(quarters):
    trend = financials.quarterly_trend(quarters)
    long = financials.unpivot(trend, ["company", "quarter_start"], ["profit", "cashflow"])
    assert long.columns == ["company", "quarter_start", "series", "value"]
    assert long.count() == 2 * trend.count()


def test_ratios(spark):
    rows = [
        (1, 2022, 100.0, 40.0, 60.0, 30.0, 20.0, 10.0, 5.0, 6.0),
        (1, 2023, 150.0, 50.0, 100.0, 30.0, 20.0, 0.0, 5.0, 6.0),
        (1, 2025, 300.0, 0.0, 100.0, 30.0, 20.0, 10.0, 5.0, 6.0),
    ]
    df = financials.ratios(spark.createDataFrame(rows, STATEMENTS)).orderBy("fiscal_year")
    a, b, c = df.collect()
    assert (a.debt_ratio, a.roa, a.cfo_to_total_debt, a.current_ratio, a.quick_ratio) == (1.5, 0.05, 0.1, 3.0, 2.0)
    assert a.total_asset_growth_rate is None and b.total_asset_growth_rate == 0.5
    assert b.current_ratio is None and c.debt_ratio is None
    assert c.total_asset_growth_rate is None  # the year before is missing
    assert financials.latest_period(df).first().fiscal_year == 2025
    assert financials.of_year(df, 2023).count() == 1


def test_displayed(spark):
    df = spark.createDataFrame([(1, 2024, None, 0.123456, float("nan"), 2.0, -0.5, 0.0)], METRICS)
    assert list(financials.displayed(df).first())[2:] == ["0.00%", "12.35%", "-", "200.00%", "-50.00%", "0.00%"]
    assert financials.displayed(df, "null").first().debt_ratio == "-"


def test_request_metrics(spark):
    rows = [(c, y, *[c / 10.0] * 6) for c in (1, 2) for y in (2023, 2024)]
    df = spark.createDataFrame(rows, METRICS)
    codes = spark.createDataFrame([(2,), (2,), (9,)], "company BIGINT")
    assert financials.request_metrics(df, codes).collect() == [(2, 2024, *[0.2] * 6)]
    assert financials.request_metrics(df, codes, all_periods=True).count() == 2
    assert financials.request_metrics(df, percent_format=True).filter("company = 1").first().roa == "10.00%"

import pytest

from solvenza.operators import portfolio
from solvenza.schemas import PORTFOLIO

ROWS = [
    ("a", "AAA", 1234, 3.0, "정상", "없음", "담당 1", "유지"),
    ("b", "AA", 0, 0.0, "주의", "예금", "담당 2", "하락"),
    ("c", "A", 4999, 4.5, "연체", "예금", "담당 2", "상승"),
    ("d", "A", 1000, 3.1, "보류", "예금", "담당 2", "하락"),
]


@pytest.fixture(scope="module")
def loans(spark):
    return spark.createDataFrame(ROWS, PORTFOLIO)


def test_summary(loans):
    assert tuple(portfolio.summary(loans).first()) == (4, 7233, 2, 2, "7,233억 원")


def test_summary_of_nothing(loans):
    assert tuple(portfolio.summary(loans.limit(0)).first()) == (0, 0, 0, 0, "0억 원")


def test_view(loans):
    rows = {r.name: r for r in portfolio.view(loans).collect()}
    assert [rows[n].loan_text for n in "abcd"] == ["1,234억", "-", "4,999억", "1,000억"]
    assert [rows[n].rate_text for n in "abcd"] == ["3%", "-", "4.5%", "3.1%"]
    assert [rows[n].delinquency_label for n in "abcd"] == ["정상", "주의", "연체", "보류"]
    assert [rows[n].rating_change_label for n in "abcd"] == ["등급 유지", "등급 하락", "등급 상승", "등급 하락"]

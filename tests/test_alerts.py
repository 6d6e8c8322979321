import datetime as dt

import pytest

from solvenza.operators import alerts
from solvenza.schemas import NEWS_ITEMS, NOTIFICATIONS

WEEK = dt.datetime(2024, 1, 4)  # a Thursday, where 7-day windows start

# The three sample notifications, in arrival order.
SAMPLES = [
    (1, "down", 10, "t1", "AAA → AA", "k1", WEEK, False),
    (2, "warning", 20, "t2", None, "k2", WEEK + dt.timedelta(seconds=5), False),
    (3, "up", 30, "t3", "AA → AA+", "k3", WEEK + dt.timedelta(seconds=10), False),
]


def observations(spark, rows):
    full = [(c, i, ts, g, "kw") for c, i, ts, g in rows]
    return spark.createDataFrame(full, "company BIGINT, id BIGINT, ts TIMESTAMP_NTZ, grade STRING, news_keywords STRING")


def articles(spark, counts):
    """counts: (company, week number, negative articles)."""
    rows, n = [], 1000
    for company, week, negatives in counts:
        for i in range(negatives):
            n += 1
            rows.append((company, n, f"h{n}", None, None, WEEK + dt.timedelta(days=7 * week, hours=i), None, "negative"))
    return spark.createDataFrame(rows, NEWS_ITEMS)


def test_grade_alerts(spark):
    rows = [(1, 1, WEEK, "AAA"), (1, 2, WEEK + dt.timedelta(hours=2), "AA"),
            (1, 3, WEEK + dt.timedelta(hours=3), "AA"), (1, 4, WEEK + dt.timedelta(hours=4), "AA+")]
    got = alerts.grade_alerts(observations(spark, rows)).orderBy("id").collect()
    assert [(r.id, r.type, r.rating_change, r.title) for r in got] == [
        (2, "down", "AAA → AA", "신용 등급이 AA로 하향 조정되었습니다."),
        (4, "up", "AA → AA+", "신용 등급이 AA+로 상향 조정되었습니다."),
    ]


def test_warnings(spark):
    news = articles(spark, [
        (1, 0, 20), (1, 1, 27),          # +35 %: warned
        (2, 0, 20), (2, 1, 26),          # +30 %: not
        (3, 0, 2), (3, 1, 4),            # grade moved that week: not
        (4, 0, 2), (4, 2, 4),            # no articles the week before: not
        (5, 0, 2), (5, 1, 4),            # grade moved the week before: warned
        (6, 1, 9),                       # first week: not
    ])
    hour = dt.timedelta(hours=1)
    seen = observations(spark, [
        (1, 1, WEEK, "AA"), (1, 2, WEEK + dt.timedelta(days=8), "AA"),
        (3, 3, WEEK, "AA"), (3, 4, WEEK + dt.timedelta(days=8), "A"),
        (5, 5, WEEK, "AA"), (5, 6, WEEK + hour, "A"), (5, 7, WEEK + dt.timedelta(days=8), "A"),
    ])
    got = {r.company: r for r in alerts.news_warnings(seen, news).collect()}
    assert sorted(got) == [1, 5]
    last = max((r.published_at, r.id) for r in news.filter("company = 1").collect())
    assert (got[1].ts, got[1].id, got[1].type, got[1].rating_change) == (*last, "warning", None)
    assert sorted(r.company for r in alerts.news_warnings(seen, news, growth=0.3).collect()) == [1, 2, 5]
    both = alerts.rating_alerts(seen, news)
    assert {(r.type, r.company) for r in both.collect()} == {
        ("warning", 1), ("warning", 5), ("down", 3), ("down", 5),
    }


@pytest.fixture(scope="module")
def feed(spark):
    return spark.createDataFrame(SAMPLES, NOTIFICATIONS)


def ids(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "id BIGINT")


def test_summary_before_and_after_reading(feed, spark):
    assert tuple(alerts.summary(feed).first()) == (3, 3, 0)
    marked = alerts.mark_read(feed, ids(spark, 2, 2, 99))
    total, unread, read = alerts.summary(marked).first()
    assert (total, unread, read) == (3, 2, 1) and unread + read == total
    assert [r.id for r in alerts.read(marked).collect()] == [2]
    assert sorted(r.id for r in alerts.unread(marked).collect()) == [1, 3]
    again = alerts.mark_read(marked, ids(spark, 1))
    assert tuple(alerts.summary(again).first()) == (3, 1, 2)
    assert tuple(alerts.summary(feed.limit(0)).first()) == (0, 0, 0)


def test_mark_read_marks_every_copy(feed, spark):
    marked = alerts.mark_read(feed.unionByName(feed), ids(spark, 1))
    assert sorted((r.id, r.is_read) for r in marked.collect()) == [
        (1, True), (1, True), (2, False), (2, False), (3, False), (3, False),
    ]


def test_ordinals_newest_first(feed):
    owned = feed.selectExpr("*", "1 AS inbox")
    rows = alerts.newest_first(alerts.with_ordinal(owned)).collect()
    assert [(r.id, r.ordinal) for r in rows] == [(3, 3), (2, 2), (1, 1)]


def test_view(feed, spark):
    rows = {r.id: r for r in alerts.view(alerts.mark_read(feed, ids(spark, 1))).collect()}
    assert (rows[1].type_label, rows[1].read_label, rows[1].time_text) == ("등급 하락", "읽음", "2024. 1. 4. 오전 12:00:00")
    assert (rows[2].type_label, rows[2].read_label, rows[2].rating_change) == ("하락 위험", "읽지 않음", None)

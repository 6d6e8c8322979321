"""Entity schemas, as DDL texts, and the fixed value domains."""

from __future__ import annotations

# The grade scale, best grade first.
GRADE_SCALE = (
    "AAA", "AA+", "AA", "AA-", "A+", "A", "A-",
    "BBB+", "BBB", "BBB-", "BB+", "BB", "BB-",
    "B+", "B", "B-", "CCC", "CC", "C", "D",
)

# Portfolio domains.
PORTFOLIO_RATINGS = "AAA", "AA+", "AA", "AA-", "A+", "A", "BBB+"
DELINQUENCIES = "정상", "주의", "연체"
RATING_CHANGES = "유지", "상승", "하락"

# Own sample values; no rule reads them.
COLLATERALS = "토지", "채권", "예금", "없음"
RELATIONSHIP_MANAGERS = "담당 1", "담당 2", "담당 3", "담당 4", "담당 5", "담당 6"

# Direction of a grade observation against the one before it.
RAISED, LOWERED, HELD = "상향", "하향", "유지"

# Windows and limits.
BUCKET = "3 minutes"
RETENTION_DAYS = 180
NEWS_DAYS = 3
NEWS_LIMIT = 20
WARNING_GROWTH = 0.35
NO_VALUE = "-"

SENTIMENTS = ("positive", "negative", "neutral")
RATIOS = (
    "debt_ratio", "roa", "total_asset_growth_rate",
    "cfo_to_total_debt", "current_ratio", "quick_ratio",
)

CATALOG = "name STRING NOT NULL, industry STRING, description STRING"
PORTFOLIO = (
    "name STRING NOT NULL, rating STRING, loan_amount BIGINT, interest_rate DOUBLE, "
    "delinquency STRING, collateral STRING, rm STRING, rating_change STRING"
)
ADD_REQUESTS = "request_id BIGINT, request_ts TIMESTAMP_NTZ, name STRING"
NOTIFICATIONS = (
    "id BIGINT, type STRING, company BIGINT, title STRING, rating_change STRING, "
    "news_keywords STRING, ts TIMESTAMP_NTZ, is_read BOOLEAN"
)
METRICS = (
    "company BIGINT, fiscal_year INT, " + ", ".join(f"{r} DOUBLE" for r in RATIOS)
)
METRICS_RESPONSE = (
    "data ARRAY<STRUCT<stock_code: STRING, " + ", ".join(f"{r}: DOUBLE" for r in RATIOS) + ">>"
)
STATEMENTS = (
    "company BIGINT, fiscal_year INT, total_assets DOUBLE, equity DOUBLE, "
    "total_liabilities DOUBLE, current_assets DOUBLE, quick_assets DOUBLE, "
    "current_liabilities DOUBLE, net_income DOUBLE, cfo DOUBLE"
)
CREDIT_RESPONSE = "ratings MAP<STRING, STRING>"
NEWS_ITEMS = (
    "company BIGINT, id BIGINT, title STRING, link STRING, press STRING, "
    "published_at TIMESTAMP_NTZ, summary STRING, sentiment STRING"
)
NEWS_RESPONSE = (
    "results ARRAY<STRUCT<query: STRING, news_count: BIGINT, "
    "aggregate: STRUCT<POSITIVE: BIGINT, NEGATIVE: BIGINT, NEUTRAL: BIGINT, "
    "positive_ratio: DOUBLE, negative_ratio: DOUBLE, neutral_ratio: DOUBLE>, "
    "news_sentiment_score: DOUBLE, sentiment_volatility: DOUBLE, recency_weight_mean: DOUBLE, "
    "items: ARRAY<STRUCT<title: STRING, link: STRING, press: STRING, "
    "published_at: STRING, summary: STRING, sentiment: STRING>>>>"
)
NONFINANCIAL_RESPONSE = (
    "results ARRAY<STRUCT<company: STRING, score: STRUCT<final_score: DOUBLE>>>"
)
GRADE_OBSERVATIONS = "company BIGINT, id BIGINT, ts TIMESTAMP_NTZ, grade STRING"
CREDIT_POINTS = (
    "company BIGINT, bucket_start TIMESTAMP_NTZ, score INT, label STRING"
)
FEATURE_TYPES = {
    "company": "BIGINT",
    **{r: "DOUBLE" for r in RATIOS},
    "news_sentiment_score": "DOUBLE",
    "news_count": "BIGINT",
    "sentiment_volatility": "DOUBLE",
    "positive_ratio": "DOUBLE",
    "negative_ratio": "DOUBLE",
    "recency_weight_mean": "DOUBLE",
    "business_report_text_score": "DOUBLE",
    "public_credit_rating": "STRING",
}
FEATURES = ", ".join(f"{name} {kind}" for name, kind in FEATURE_TYPES.items())

# The star-schema, event and text tables the entities are derived from.
TABLES = {
    "customer": (
        "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING"
    ),
    "orders": (
        "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
        "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING"
    ),
    "lineitem": (
        "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, "
        "l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, "
        "l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ"
    ),
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": (
        "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, "
        "p_retailprice DOUBLE"
    ),
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "events": (
        "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, "
        "props STRING"
    ),
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "labels": "doc_id BIGINT, quality INT, toxic INT",
    "pages": "page_id BIGINT, url STRING, html STRING",
}

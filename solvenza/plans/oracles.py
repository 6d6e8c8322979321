"""DuckDB SQL that computes each named query on its own terms."""

from __future__ import annotations

_SCALE = (
    "['AAA','AA+','AA','AA-','A+','A','A-','BBB+','BBB','BBB-','BB+','BB','BB-',"
    "'B+','B','B-','CCC','CC','C','D']"
)

_CATALOG = "catalog AS (SELECT c_name AS name, c_mktsegment AS industry FROM customer)"
_WATCHLIST = "watchlist AS (SELECT c_name AS name FROM customer WHERE c_acctbal < 0)"
_REQUESTS = """requests AS (
  SELECT o_orderkey AS request_id, o_orderdate AS request_ts,
         'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS name FROM orders
  UNION ALL
  SELECT -1 - s_suppkey, TIMESTAMP '1995-01-01 00:00:00', s_name FROM supplier)"""

_OBSERVATIONS = f"""obs AS (
  SELECT company, id, ts, grade, news_keywords,
         CAST(coalesce(list_position({_SCALE}, grade), 0) - 1 AS INTEGER) AS score
  FROM (SELECT user_id AS company, event_id AS id, ts, event_type AS news_keywords,
               CASE event_type WHEN 'view' THEN 'AAA' WHEN 'click' THEN 'AA' WHEN 'signup' THEN 'A+'
                    WHEN 'purchase' THEN 'BBB' WHEN 'error' THEN 'NR' END AS grade
        FROM events))"""
_CHANGES = f"""{_OBSERVATIONS},
steps AS (
  SELECT *, lag(grade) OVER w AS before, lag(score) OVER w AS before_score
  FROM obs WHERE score >= 0 WINDOW w AS (PARTITION BY company ORDER BY ts, id)),
changes AS (
  SELECT *, CASE WHEN score < before_score THEN '상향' WHEN score > before_score THEN '하향'
                 ELSE '유지' END AS direction,
         coalesce(last_value(CASE WHEN before <> grade THEN before || ' → ' || grade END IGNORE NULLS)
                  OVER (PARTITION BY company ORDER BY ts, id
                        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS last_change
  FROM steps)"""
_BUCKETS = f"""{_OBSERVATIONS},
buckets AS (
  SELECT company, bucket_start, score, grade AS label FROM (
    SELECT *, time_bucket(INTERVAL 3 MINUTE, ts) AS bucket_start,
           row_number() OVER (PARTITION BY company, time_bucket(INTERVAL 3 MINUTE, ts)
                              ORDER BY ts DESC, id DESC) AS n
    FROM obs WHERE score >= 0) WHERE n = 1)"""
_ITEMS = """items AS (
  SELECT user_id AS company, event_id AS id, ts AS published_at, event_type AS title,
         CASE WHEN event_type IN ('purchase', 'signup') THEN 'positive'
              WHEN event_type = 'error' THEN 'negative' ELSE 'neutral' END AS sentiment
  FROM events),
latest_event AS (SELECT max(ts) AS t FROM events)"""


def _block(days: int) -> str:
    return f"""{_ITEMS},
recent AS (
  SELECT * FROM (
    SELECT items.*, t, row_number() OVER (PARTITION BY company ORDER BY published_at DESC, id) AS recency_rank
    FROM items, latest_event WHERE published_at > t - INTERVAL {days} DAY) WHERE recency_rank <= 20),
block AS (
  SELECT company, count(*) AS news_count,
         CAST(count(*) FILTER (sentiment = 'positive') AS BIGINT) AS positive,
         CAST(count(*) FILTER (sentiment = 'negative') AS BIGINT) AS negative,
         CAST(count(*) FILTER (sentiment = 'neutral') AS BIGINT) AS neutral,
         avg(CASE sentiment WHEN 'positive' THEN 1 WHEN 'negative' THEN -1 ELSE 0 END) AS score,
         stddev_pop(CASE sentiment WHEN 'positive' THEN 1 WHEN 'negative' THEN -1 ELSE 0 END) AS volatility,
         avg(1 - (epoch(date_trunc('second', t)) - epoch(date_trunc('second', published_at)))
                 / ({days} * 86400.0)) AS recency
  FROM recent GROUP BY company)"""


def _statements(period: str, where: str = "true") -> str:
    return f"""st AS (
  SELECT l_suppkey AS company, {period} AS period,
         CAST(sum(price) AS DOUBLE) AS total_assets,
         CAST(coalesce(sum(price) FILTER (l_returnflag = 'N'), 0) AS DOUBLE) AS equity,
         CAST(coalesce(sum(price) FILTER (l_returnflag IN ('A', 'R')), 0) AS DOUBLE) AS liabilities,
         CAST(coalesce(sum(price) FILTER (l_returnflag = 'R'), 0) AS DOUBLE) AS current_liabilities,
         CAST(coalesce(sum(price) FILTER (l_linestatus = 'O'), 0) AS DOUBLE) AS current_assets,
         CAST(coalesce(sum(price) FILTER (l_linestatus = 'O' AND l_returnflag <> 'A'), 0) AS DOUBLE) AS quick_assets,
         CAST(sum(price * disc) AS DOUBLE) AS net_income,
         CAST(sum(price * tax) AS DOUBLE) AS cfo
  FROM (SELECT *, CAST(l_extendedprice AS DECIMAL(14, 2)) AS price,
               CAST(l_discount AS DECIMAL(4, 2)) AS disc, CAST(l_tax AS DECIMAL(4, 2)) AS tax
        FROM lineitem WHERE {where})
  GROUP BY ALL)"""


_YEARLY = _statements("CAST(year(l_shipdate) AS INTEGER)")
_QUARTERLY = _statements("CAST(date_trunc('quarter', l_shipdate) AS TIMESTAMP)")
_RATIO_SELECT = """
  SELECT a.company, a.period AS fiscal_year,
         a.liabilities / nullif(a.equity, 0) AS debt_ratio,
         a.net_income / nullif(a.total_assets, 0) AS roa,
         (a.total_assets - b.total_assets) / nullif(b.total_assets, 0) AS total_asset_growth_rate,
         a.cfo / nullif(a.liabilities, 0) AS cfo_to_total_debt,
         a.current_assets / nullif(a.current_liabilities, 0) AS current_ratio,
         a.quick_assets / nullif(a.current_liabilities, 0) AS quick_ratio
  FROM st a LEFT JOIN st b ON b.company = a.company AND b.period = a.period - 1"""
_RATIOS = f"{_YEARLY},\nratios AS ({_RATIO_SELECT})"
_NAMES = (
    "debt_ratio", "roa", "total_asset_growth_rate", "cfo_to_total_debt", "current_ratio", "quick_ratio",
)
_ROUNDED_RATIOS = ", ".join(f"round({n}, 6) AS {n}" for n in _NAMES)
_LATEST = """latest AS (
  SELECT r.* FROM ratios r
  JOIN (SELECT company, max(fiscal_year) AS y FROM ratios GROUP BY company) m
    ON m.company = r.company AND m.y = r.fiscal_year)"""


def _points(value: str) -> str:
    return f"CAST(floor(abs({value}) * 10000 + 0.5) AS HUGEINT)"


def _percent(value: str) -> str:
    v = f"coalesce({value}, 0.0)"
    p = _points(v)
    return (
        f"CASE WHEN {v} < 0 THEN '-' ELSE '' END || CAST({p} // 100 AS VARCHAR) || '.' || "
        f"lpad(CAST({p} % 100 AS VARCHAR), 2, '0') || '%'"
    )


def _stored(value: str) -> str:
    return f"sign(coalesce({value}, 0.0)) * {_points(f'coalesce({value}, 0.0)')} / 100.0::DOUBLE / 100"


_RATINGS = f"""ratings AS (
  SELECT c_custkey AS company, c_name AS name,
         CASE WHEN c_acctbal >= 0
              THEN {_SCALE}[CAST(greatest(0, 19 - floor(c_acctbal / 500)) AS INTEGER) + 1] END AS rating
  FROM customer)"""
_SCORES = """scores AS (
  SELECT TRY_CAST(regexp_extract(source, '[0-9]+') AS BIGINT) AS company, avg(quality) AS final_score
  FROM documents JOIN labels USING (doc_id) GROUP BY 1)"""
_SOURCES = f"{_RATIOS},\n{_LATEST},\n{_RATINGS},\n{_SCORES},\n{_block(3)}"

_DOMINANCE = f"""{_QUARTERLY},
market AS (
  SELECT company, period, total_assets AS sales,
         100 * total_assets / max(total_assets) OVER (PARTITION BY period) AS dominance FROM st),
dom AS (
  SELECT a.company, a.period, a.dominance,
         a.dominance - (SELECT max(b.dominance) FROM market b
                        WHERE b.period = a.period AND b.company <> a.company) AS gap
  FROM market a)"""
_QUARTER_LABEL = "'Q' || quarter(period) || ' ' || year(period)"

_WARNINGS = """weeks AS (
  SELECT company, time_bucket(INTERVAL 7 DAY, published_at, TIMESTAMP '1970-01-01') AS week_start,
         count(*) AS n, max(published_at) AS last_at
  FROM items WHERE sentiment = 'negative' GROUP BY ALL),
moved AS (
  SELECT DISTINCT company, time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01') AS week_start
  FROM changes WHERE direction <> '유지'),
warnings AS (
  SELECT i.id, 'warning' AS type, w.company, '등급 하향 가능성이 있습니다.' AS title,
         CAST(NULL AS VARCHAR) AS rating_change, i.title AS news_keywords, i.published_at AS ts
  FROM weeks w
  JOIN weeks p ON p.company = w.company AND p.week_start = w.week_start - INTERVAL 7 DAY
  JOIN items i ON i.company = w.company AND i.published_at = w.last_at AND i.sentiment = 'negative'
  WHERE (w.n - p.n) / p.n >= 0.35
    AND NOT EXISTS (SELECT 1 FROM moved m WHERE m.company = w.company AND m.week_start = w.week_start))"""
_ALERTS = f"""{_CHANGES},
{_ITEMS},
{_WARNINGS},
alerts AS (
  SELECT id, CASE direction WHEN '하향' THEN 'down' ELSE 'up' END AS type, company,
         '신용 등급이 ' || grade || CASE direction WHEN '하향' THEN '로 하향 조정되었습니다.'
                                    ELSE '로 상향 조정되었습니다.' END AS title,
         before || ' → ' || grade AS rating_change, news_keywords, ts
  FROM changes WHERE direction <> '유지'
  UNION ALL SELECT * FROM warnings)"""
_INBOX = f"""{_ALERTS},
inbox AS (
  SELECT a.*, company % 10 AS inbox,
         EXISTS (SELECT 1 FROM events e
                 WHERE e.event_id = a.id
                   AND CAST(json_extract_string(e.props, '$.k') AS INTEGER) >= 50) AS is_read
  FROM alerts a)"""

_HOUR12 = "CAST((hour({0}) + 11) % 12 + 1 AS VARCHAR)"
_HALF = "CASE WHEN hour({0}) < 12 THEN '오전' ELSE '오후' END"


def _pad(value: str) -> str:
    return f"lpad(CAST({value} AS VARCHAR), 2, '0')"


def _short_time(ts: str) -> str:
    return (
        f"strftime({ts}, '%m. %d. ') || {_HALF.format(ts)} || strftime({ts}, ' %I:%M')"
    )


def _full_time(ts: str) -> str:
    return (
        f"year({ts}) || '. ' || month({ts}) || '. ' || day({ts}) || '. ' || {_HALF.format(ts)} "
        f"|| ' ' || {_HOUR12.format(ts)} || strftime({ts}, ':%M:%S')"
    )


_SNAPSHOTS = f"""{_SOURCES},
daily AS (
  SELECT company, time_bucket(INTERVAL 1 DAY, published_at) AS snapshot_ts, count(*) AS news_count,
         avg(CASE sentiment WHEN 'positive' THEN 1 WHEN 'negative' THEN -1 ELSE 0 END) AS score,
         stddev_pop(CASE sentiment WHEN 'positive' THEN 1 WHEN 'negative' THEN -1 ELSE 0 END) AS volatility,
         avg(CASE sentiment WHEN 'positive' THEN 1.0 ELSE 0.0 END) AS positive_ratio,
         avg(CASE sentiment WHEN 'negative' THEN 1.0 ELSE 0.0 END) AS negative_ratio,
         avg((epoch(date_trunc('second', published_at)) % 86400) / 86400.0) AS recency
  FROM items GROUP BY ALL),
snaps AS (
  SELECT d.company, d.snapshot_ts, d.news_count, d.score AS news_score, r.rating, s.final_score,
         d.volatility, d.positive_ratio, d.negative_ratio, d.recency,
         {', '.join(f'{_stored("l." + n)} AS {n}' for n in _NAMES)}
  FROM daily d JOIN latest l USING (company) JOIN ratings r USING (company) JOIN scores s USING (company)
  WHERE r.rating IS NOT NULL),
keyed AS (
  SELECT *, row(rating, news_score, final_score, {', '.join(_NAMES)}) AS k FROM snaps)"""

_ORACLES = {
    "company_search": f"WITH {_CATALOG} SELECT name, industry FROM catalog WHERE contains(lower(name), lower('12'))",
    "search_count": f"""WITH {_CATALOG} SELECT count(*) AS n_results, count(*) = 0 AS is_empty
        FROM catalog WHERE contains(lower(name), lower('12'))""",
    "search_flagged": f"""WITH {_CATALOG}, {_WATCHLIST}
        SELECT name, industry, name IN (SELECT name FROM watchlist) AS is_added
        FROM catalog WHERE contains(lower(name), '12')""",
    "search_bulk": f"""WITH {_CATALOG}, terms AS (
          SELECT CAST(p_size AS VARCHAR) AS term FROM part
          UNION SELECT 'OMER' || substr(s_name, 9) FROM supplier)
        SELECT term, name FROM terms JOIN catalog ON contains(lower(name), lower(term))""",
    "watchlist_add": f"""WITH {_CATALOG}, {_WATCHLIST}, {_REQUESTS}
        SELECT request_id, request_ts, name,
               CASE WHEN name IN (SELECT name FROM watchlist) THEN 'already_added'
                    WHEN name NOT IN (SELECT name FROM catalog) THEN 'unknown'
                    WHEN row_number() OVER (PARTITION BY name ORDER BY request_ts, request_id) = 1
                    THEN 'added' ELSE 'already_added' END AS outcome
        FROM requests""",
    "watchlist_semi": f"""WITH {_CATALOG}, {_WATCHLIST}
        SELECT name, industry FROM catalog WHERE EXISTS (
          SELECT 1 FROM watchlist w WHERE w.name = catalog.name)""",
    "watchlist_anti": f"""WITH {_WATCHLIST}, {_REQUESTS}
        SELECT DISTINCT name FROM requests WHERE name NOT IN (SELECT name FROM watchlist)""",
    "watchlist_union": f"""WITH {_CATALOG}, {_WATCHLIST}, {_REQUESTS}
        SELECT name, CAST(NULL AS TIMESTAMP) AS added_ts FROM watchlist
        UNION ALL
        SELECT name, min(request_ts) FROM requests
        WHERE name IN (SELECT name FROM catalog) AND name NOT IN (SELECT name FROM watchlist)
        GROUP BY name""",
    "managed_union": """WITH lists AS (
          SELECT c_nationkey AS owner, list_sort(list(DISTINCT c_mktsegment)) AS names
          FROM customer GROUP BY 1),
        added AS (
          SELECT owner, names,
                 CASE WHEN n_nationkey % 2 = 0 THEN 'BUILDING' ELSE n_name END AS name
          FROM (SELECT n_nationkey AS owner, n_nationkey, n_name, coalesce(names, []) AS names
                FROM nation LEFT JOIN lists ON owner = n_nationkey))
        SELECT owner, '[' || array_to_string(list_transform(
                 CASE WHEN list_contains(names, name) THEN names ELSE list_append(names, name) END,
                 lambda x: '"' || x || '"'), ',') || ']' AS stored
        FROM added""",
    "portfolio_summary": """SELECT count(*) AS n_companies,
          CAST(sum(floor(o_totalprice)) AS BIGINT) AS total_loan,
          CAST(count(*) FILTER (o_orderstatus IN ('O', 'P')) AS BIGINT) AS n_delinquent,
          CAST(count(*) FILTER (o_orderkey % 3 = 2) AS BIGINT) AS n_downgraded,
          format('{:,}', CAST(sum(floor(o_totalprice)) AS BIGINT)) || '억 원' AS total_loan_text
        FROM orders""",
    "portfolio_view": """SELECT 'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS name,
          CASE left(o_orderpriority, 1) WHEN '1' THEN 'AAA' WHEN '2' THEN 'AA+' WHEN '3' THEN 'AA'
               WHEN '4' THEN 'AA-' WHEN '5' THEN 'A+' END AS rating,
          CASE WHEN floor(o_totalprice) > 0
               THEN format('{:,}', CAST(floor(o_totalprice) AS BIGINT)) || '억' ELSE '-' END AS loan_text,
          CASE WHEN o_orderkey % 22 = 21 THEN '-'
               ELSE (30 + o_orderkey % 22) // 10
                    || CASE WHEN o_orderkey % 22 % 10 = 0 THEN '' ELSE '.' || o_orderkey % 22 % 10 END
                    || '%' END AS rate_text,
          CASE o_orderstatus WHEN 'F' THEN '정상' WHEN 'O' THEN '주의' WHEN 'P' THEN '연체' END
            AS delinquency_label,
          ['토지', '채권', '예금', '없음'][o_custkey % 4 + 1] AS collateral,
          '담당 ' || (o_custkey % 6 + 1) AS rm,
          ['등급 유지', '등급 상승', '등급 하락'][o_orderkey % 3 + 1] AS rating_change_label
        FROM orders""",
    "grade_index": f"""WITH {_OBSERVATIONS} SELECT id, grade, score,
          CASE WHEN score >= 0 THEN grade ELSE '' END AS label FROM obs""",
    "grade_direction": f"""WITH {_CHANGES} SELECT company, id, ts, grade, score, direction,
          CASE direction WHEN '상향' THEN '등급상승' WHEN '하향' THEN '등급하락' ELSE '등급유지' END
            AS direction_label FROM changes""",
    "grade_last_change": f"WITH {_CHANGES} SELECT company, id, ts, grade, last_change FROM changes",
    "credit_buckets": f"WITH {_BUCKETS} SELECT company, bucket_start, score, label FROM buckets",
    "credit_extent": f"""WITH {_BUCKETS} SELECT company, min(bucket_start) AS first_bucket,
          max(bucket_start) AS last_bucket FROM buckets GROUP BY company""",
    "credit_retention": f"""WITH {_BUCKETS} SELECT company, bucket_start, score, label FROM buckets
        WHERE bucket_start >= (SELECT max(ts) + INTERVAL 165 DAY - INTERVAL 180 DAY FROM events)""",
    "grade_asof": f"""WITH {_BUCKETS}, probes AS (
          SELECT user_id AS company, event_id AS id, ts FROM events WHERE event_type = 'error')
        SELECT p.company, p.id, p.ts, coalesce(b.score, -1) AS score_asof, b.label AS grade_asof
        FROM probes p ASOF LEFT JOIN buckets b ON b.company = p.company AND b.bucket_start <= p.ts""",
    "news_recent": f"""WITH {_block(30)} SELECT company, id, published_at, title, sentiment, recency_rank,
          {_short_time('published_at')} AS time_text FROM recent""",
    "news_sentiment": f"""WITH {_block(3)} SELECT company, news_count, positive, negative, neutral,
          round(positive / news_count, 6) AS positive_ratio, round(negative / news_count, 6) AS negative_ratio,
          round(neutral / news_count, 6) AS neutral_ratio, round(score, 6) AS news_sentiment_score,
          round(volatility, 6) AS sentiment_volatility, round(recency, 6) AS recency_weight_mean
        FROM block""",
    "news_display": f"""WITH {_block(30)} SELECT company, news_count,
          positive AS positive_shown, {_percent('positive / news_count')} AS positive_percent,
          negative AS negative_shown, {_percent('negative / news_count')} AS negative_percent,
          CASE WHEN positive > negative THEN '긍정' WHEN positive < negative THEN '부정' ELSE '중립' END
            AS overall_label
        FROM block""",
    "weekly_sentiment": f"""WITH {_ITEMS} SELECT company,
          time_bucket(INTERVAL 7 DAY, published_at, TIMESTAMP '1970-01-01') AS week_start,
          CAST(sum(CASE WHEN sentiment = 'positive' THEN 1 ELSE 0 END) AS BIGINT) AS positive,
          CAST(sum(CASE WHEN sentiment = 'negative' THEN 1 ELSE 0 END) AS BIGINT) AS negative,
          CAST(sum(CASE WHEN sentiment = 'neutral' THEN 1 ELSE 0 END) AS BIGINT) AS neutral
        FROM items GROUP BY ALL""",
    "link_host": """SELECT page_id, url AS link,
          starts_with(lower(url), 'http://') OR starts_with(lower(url), 'https://') AS is_url,
          lower(split_part(split_part(split_part(split_part(url, '://', 2), '/', 1), '?', 1), '#', 1)) AS host
        FROM pages""",
    "financial_ratios": f"WITH {_RATIOS} SELECT company, fiscal_year, {_ROUNDED_RATIOS} FROM ratios",
    "metrics_latest": f"WITH {_RATIOS}, {_LATEST} SELECT company, fiscal_year, {_ROUNDED_RATIOS} FROM latest",
    "metrics_year": f"WITH {_RATIOS} SELECT company, fiscal_year, {_ROUNDED_RATIOS} FROM ratios WHERE fiscal_year = 1998",
    "ratio_display": f"""WITH {_RATIOS} SELECT company, fiscal_year,
          {', '.join(f'{_percent(n)} AS {n}' for n in _NAMES)} FROM ratios""",
    "quarterly_trend": f"""WITH {_QUARTERLY} SELECT company, period AS quarter_start, {_QUARTER_LABEL} AS quarter,
          round(net_income / total_assets * 100, 6) AS profit, round(cfo / total_assets * 100, 6) AS cashflow
        FROM st""",
    "quarterly_debt_ratio": f"""WITH {_QUARTERLY} SELECT company, period AS quarter_start,
          {_QUARTER_LABEL} AS quarter, round(liabilities / nullif(equity, 0) * 100, 6) AS ratio FROM st""",
    "market_dominance": f"""WITH {_DOMINANCE} SELECT company, period AS quarter_start, {_QUARTER_LABEL} AS quarter,
          round(dominance, 6) AS dominance, round(gap, 6) AS competitor_gap FROM dom""",
    "period_change": f"""WITH {_QUARTERLY},
        s AS (SELECT company, period, liabilities / nullif(equity, 0) * 100 AS ratio FROM st)
        SELECT a.company, a.period AS quarter_start, round(a.ratio, 6) AS ratio,
               round(a.ratio - q.ratio, 6) AS qoq_points,
               round((a.ratio - q.ratio) / nullif(q.ratio, 0), 6) AS qoq_rate,
               round(a.ratio - y.ratio, 6) AS yoy_points,
               round((a.ratio - y.ratio) / nullif(y.ratio, 0), 6) AS yoy_rate
        FROM s a
        LEFT JOIN s q ON q.company = a.company AND q.period = a.period - INTERVAL 3 MONTH
        LEFT JOIN s y ON y.company = a.company AND y.period = a.period - INTERVAL 1 YEAR""",
    "risk_indicators": f"""WITH {_DOMINANCE},
        wide AS (
          SELECT company, period, net_income / total_assets * 100 AS operating_margin,
                 liabilities / nullif(equity, 0) * 100 AS debt_ratio,
                 current_assets / nullif(current_liabilities, 0) * 100 AS current_ratio,
                 dominance AS market_confidence
          FROM st JOIN dom USING (company, period)),
        long AS (
          SELECT company, period, 'operating_margin' AS indicator, operating_margin AS value FROM wide
          UNION ALL SELECT company, period, 'debt_ratio', debt_ratio FROM wide
          UNION ALL SELECT company, period, 'current_ratio', current_ratio FROM wide
          UNION ALL SELECT company, period, 'market_confidence', market_confidence FROM wide),
        moved AS (
          SELECT a.*, a.value - b.value AS delta FROM long a
          LEFT JOIN long b ON b.company = a.company AND b.indicator = a.indicator
            AND b.period = a.period - INTERVAL 3 MONTH
          WHERE a.period = (SELECT max(c.period) FROM st c WHERE c.company = a.company))
        SELECT company, indicator, {_QUARTER_LABEL} AS quarter, round(value, 6) AS value,
               round(delta, 6) AS change_points,
               CASE WHEN delta > 0 THEN '↑' WHEN delta < 0 THEN '↓' ELSE '→' END AS direction
        FROM moved""",
    "series_unpivot": f"""WITH {_QUARTERLY}
        SELECT company, period AS quarter_start, 'profit' AS series,
               round(net_income / total_assets * 100, 6) AS value FROM st
        UNION ALL
        SELECT company, period, 'cashflow', round(cfo / total_assets * 100, 6) FROM st""",
    "nonfin_score": f"WITH {_SCORES} SELECT company, round(final_score, 6) AS final_score FROM scores",
    "public_rating_lookup": f"""WITH {_REQUESTS}, {_RATINGS}
        SELECT request_id, name, coalesce(rating, '-') AS public_rating
        FROM requests LEFT JOIN ratings USING (name)""",
    "feature_ready": f"""WITH {_SOURCES}
        SELECT c_custkey AS company,
               c_custkey IN (SELECT company FROM latest) AS has_metrics,
               c_custkey IN (SELECT company FROM ratings WHERE rating IS NOT NULL) AS has_rating,
               c_custkey IN (SELECT company FROM block) AS has_news,
               c_custkey IN (SELECT company FROM scores WHERE company IS NOT NULL) AS has_score,
               c_custkey IN (SELECT company FROM latest JOIN ratings USING (company)
                             JOIN block USING (company) JOIN scores USING (company)
                             WHERE rating IS NOT NULL) AS is_ready
        FROM customer""",
    "feature_assembly": f"""WITH {_SOURCES}
        SELECT company, {', '.join(f'{_stored(n)} AS {n}' for n in _NAMES)},
               round(block.score, 6) AS news_sentiment_score, news_count,
               round(volatility, 6) AS sentiment_volatility,
               round(positive / news_count, 6) AS positive_ratio,
               round(negative / news_count, 6) AS negative_ratio,
               round(recency, 6) AS recency_weight_mean,
               round(final_score, 6) AS business_report_text_score, rating AS public_credit_rating
        FROM latest JOIN ratings USING (company) JOIN block USING (company) JOIN scores USING (company)
        WHERE rating IS NOT NULL""",
    "feature_changes": f"""WITH {_SNAPSHOTS}
        SELECT company, snapshot_ts, news_count, round(news_score, 6) AS news_sentiment_score,
               round(volatility, 6) AS sentiment_volatility, round(positive_ratio, 6) AS positive_ratio,
               round(negative_ratio, 6) AS negative_ratio, round(recency, 6) AS recency_weight_mean,
               rating AS public_credit_rating, {', '.join(_NAMES)},
               round(final_score, 6) AS business_report_text_score
        FROM (SELECT *, lag(k) OVER (PARTITION BY company ORDER BY snapshot_ts) AS k0 FROM keyed)
        WHERE k IS DISTINCT FROM k0""",
    "rating_alerts": f"WITH {_ALERTS} SELECT id, type, company, title, rating_change, news_keywords, ts FROM alerts",
    "news_warnings": f"""WITH {_ITEMS},
        graded AS (SELECT user_id AS company, ts, CASE WHEN value < 200 THEN 'AA' ELSE 'BBB' END AS grade,
                          lag(CASE WHEN value < 200 THEN 'AA' ELSE 'BBB' END)
                            OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events),
        changes AS (SELECT *, CASE WHEN grade <> before THEN '상향' ELSE '유지' END AS direction FROM graded),
        {_WARNINGS}
        SELECT id, type, company, title, rating_change, news_keywords, ts FROM warnings""",
    "notification_mark_read": f"WITH {_INBOX} SELECT id, inbox, type, is_read FROM inbox",
    "notification_summary": f"""WITH {_INBOX} SELECT count(*) AS n_total,
          CAST(count(*) FILTER (NOT is_read) AS BIGINT) AS n_unread,
          CAST(count(*) FILTER (is_read) AS BIGINT) AS n_read FROM inbox""",
    "notification_view": f"""WITH {_INBOX} SELECT id, company,
          CASE type WHEN 'down' THEN '등급 하락' WHEN 'warning' THEN '하락 위험' WHEN 'up' THEN '등급 상승' END
            AS type_label,
          CASE WHEN is_read THEN '읽음' ELSE '읽지 않음' END AS read_label,
          title, rating_change, news_keywords, {_full_time('ts')} AS time_text FROM inbox""",
    "notification_ordinal": f"""WITH {_INBOX} SELECT inbox, id, ts,
          count(*) OVER (PARTITION BY inbox)
            - row_number() OVER (PARTITION BY inbox ORDER BY ts DESC, id DESC) + 1 AS ordinal
        FROM inbox""",
    "stream_credit_buckets": f"WITH {_BUCKETS} SELECT company, bucket_start, score, label FROM buckets",
    "stream_grade_direction": f"""WITH {_CHANGES}
        SELECT company, id, ts, grade, score, direction, last_change FROM changes""",
}
_ORACLES["link_base"] = "SELECT page_id, regexp_replace(url, '/$', '') AS base FROM pages"
_ORACLES["company_search_indexed"] = _ORACLES["company_search"]
_ORACLES["search_bulk_indexed"] = _ORACLES["search_bulk"]
_ORACLES["rating_responses"] = _ORACLES["public_rating_lookup"]
_ORACLES["metrics_years"] = f"""WITH {_RATIOS} SELECT company, fiscal_year, {_ROUNDED_RATIOS} FROM ratios
  WHERE fiscal_year IN (SELECT year(o_orderdate) FROM orders
                        WHERE starts_with(o_orderpriority, '1') AND o_orderdate >= DATE '1997-01-01')"""
_ORACLES["metrics_requested"] = f"""WITH {_RATIOS} SELECT company, fiscal_year,
         {', '.join(f'{_percent(n)} AS {n}' for n in _NAMES)}
  FROM ratios SEMI JOIN (SELECT s_suppkey AS company FROM supplier WHERE s_acctbal < 5000) USING (company)"""
_ORACLES["ratio_readback"] = f"""WITH {_RATIOS} SELECT company, fiscal_year,
         {', '.join(f'CASE WHEN {n} IS NOT NULL THEN {_stored(n)} END AS {n}' for n in _NAMES)} FROM ratios"""
_ORACLES["unreadable_responses"] = f"""WITH {_SOURCES},
bodies AS (
  SELECT 'metrics' AS source, count(*) AS n FROM latest
  UNION ALL SELECT 'rating', count(*) FROM ratings
  UNION ALL SELECT 'news', count(*) FROM block
  UNION ALL SELECT 'score', count(*) FROM scores)
SELECT source, 'not JSON' AS reason, n AS n_read, n AS n_unreadable FROM bodies"""
_ORACLES["stream_rating_alerts"] = _ORACLES["rating_alerts"]
_ORACLES["stream_news_warnings"] = _ORACLES["news_warnings"]
_ORACLES["stream_news_sentiment"] = _ORACLES["news_sentiment"]
_ORACLES["stream_feature_rows"] = _ORACLES["feature_assembly"]
_ORACLES["managed_saved"] = _ORACLES["managed_union"]
_ORACLES["stream_feature_changes"] = _ORACLES["feature_changes"]
_ORACLES["stream_weekly_sentiment"] = _ORACLES["weekly_sentiment"]
_ORACLES["feature_responses"] = _ORACLES["feature_assembly"]


def all_oracles() -> dict[str, str]:
    return dict(_ORACLES)

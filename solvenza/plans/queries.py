"""The named queries: every operator over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from solvenza.functions import scalars as S
from solvenza.operators import alerts, catalog, features, financials, grades, news, portfolio
from solvenza.schemas import FEATURE_TYPES, FEATURES, RATIOS, SENTIMENTS
from solvenza.session import shared_dir, written
from solvenza.sources import feature_sink, metrics_store, polled, responses, search_index, tables as T
from solvenza.sources.sinks import feature_columns, read_managed, write_managed
from solvenza.streaming import flows
from solvenza.streaming.inputs import item_stream, observation_stream, value_stream

Query = Callable[[SparkSession, str], DataFrame]

QUERY_TEXT = "12"
NEWS_DAYS_WIDE = 30
YEAR = 1998
# The events span 30 days; this places the retention edge in the middle of them.
DAYS_AFTER_LAST_EVENT = 165

_registry: dict[str, Query] = {}


def query(fn: Query) -> Query:
    _registry[fn.__name__] = fn
    return fn


def all_queries() -> dict[str, Query]:
    return dict(_registry)


def _rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Doubles to a fixed number of digits, so two engines print the same value."""
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})


# --- companies --------------------------------------------------------------

@query
def company_search(spark, root):
    return catalog.search(T.catalog(spark, root), QUERY_TEXT).select("name", "industry")


@query
def search_count(spark, root):
    return catalog.search_count(T.catalog(spark, root), QUERY_TEXT)


@query
def search_flagged(spark, root):
    return catalog.search_flagged(T.catalog(spark, root), T.watchlist(spark, root), QUERY_TEXT)


@query
def search_bulk(spark, root):
    return catalog.search_bulk(T.catalog(spark, root), T.search_terms(spark, root))


_indexes: dict[tuple, str] = {}


def _index(spark: SparkSession, root: str) -> DataFrame:
    """The catalog's index, built of the first half of the names and extended by the rest.
    A session keeps it for as long as the catalog's files are the same."""
    names = T.catalog(spark, root)
    files = names.select("_metadata.file_modification_time", "_metadata.file_size")
    state = files.agg(F.max("file_modification_time"), F.sum("file_size"), F.count(F.lit(1))).first()
    known = spark.sparkContext.applicationId, root, tuple(state)
    if known not in _indexes:
        path, late = shared_dir(spark, "names"), F.xxhash64("name") % 2 == 0
        search_index.extend(names.filter(~late), path)
        search_index.extend(names.filter(late), path)
        _indexes[known] = path
    return search_index.read(spark, _indexes[known])


@query
def company_search_indexed(spark, root):
    return search_index.search(_index(spark, root), QUERY_TEXT)


@query
def search_bulk_indexed(spark, root):
    return search_index.search_bulk(_index(spark, root), T.search_terms(spark, root))


@query
def watchlist_add(spark, root):
    return catalog.classify_requests(
        T.add_requests(spark, root), T.watchlist(spark, root), T.catalog(spark, root)
    )


@query
def watchlist_semi(spark, root):
    return catalog.on_watchlist(T.catalog(spark, root), T.watchlist(spark, root)).select(
        "name", "industry"
    )


@query
def watchlist_anti(spark, root):
    return catalog.not_on_watchlist(T.add_requests(spark, root), T.watchlist(spark, root))


@query
def watchlist_union(spark, root):
    return catalog.append_new(
        T.watchlist(spark, root), T.add_requests(spark, root), T.catalog(spark, root)
    )


@query
def managed_union(spark, root):
    return _with_additions(spark, root, T.managed_lists(spark, root))


def _with_additions(spark: SparkSession, root: str, stored: DataFrame) -> DataFrame:
    lists = T.managed_additions(spark, root).join(stored, "owner", "left")
    after = catalog.add_to_managed(F.col("stored"), F.col("name"))
    return lists.select("owner", after.alias("stored"))


@query
def managed_saved(spark, root):
    """The same on lists that are stored, read, added to, saved over and read again."""
    path = shared_dir(spark, "managed")
    write_managed(T.managed_lists(spark, root), path)
    write_managed(_with_additions(spark, root, read_managed(spark, path)), path)
    return read_managed(spark, path)


# --- portfolio --------------------------------------------------------------

@query
def portfolio_summary(spark, root):
    return portfolio.summary(T.portfolio(spark, root))


@query
def portfolio_view(spark, root):
    return portfolio.view(T.portfolio(spark, root))


# --- grades -----------------------------------------------------------------

@query
def grade_index(spark, root):
    index = S.grade_index(F.col("grade"))
    return T.grade_observations(spark, root).select(
        "id", "grade", index.alias("score"), S.grade_label(index).alias("label")
    )


@query
def grade_direction(spark, root):
    return grades.directions(T.grade_observations(spark, root))


@query
def grade_last_change(spark, root):
    changes = grades.with_changes(T.grade_observations(spark, root))
    return changes.select("company", "id", "ts", "grade", "last_change")


@query
def credit_buckets(spark, root):
    return grades.in_time_order(grades.credit_buckets(T.grade_observations(spark, root)))


@query
def credit_extent(spark, root):
    return grades.extent(grades.credit_buckets(T.grade_observations(spark, root)))


@query
def credit_retention(spark, root):
    asof = T.latest_event(spark, root) + F.make_dt_interval(F.lit(DAYS_AFTER_LAST_EVENT))
    return grades.retained_buckets(T.grade_observations(spark, root), asof)


@query
def grade_asof(spark, root):
    """Grade in force when each negative article came out."""
    negative = T.news_items(spark, root).filter(F.col("sentiment") == "negative")
    probes = negative.select("company", "id", F.col("published_at").alias("ts"))
    points = grades.credit_buckets(T.grade_observations(spark, root))
    return grades.grade_asof(probes, points)


# --- news -------------------------------------------------------------------

@query
def news_recent(spark, root):
    latest = news.recent(T.news_items(spark, root), T.latest_event(spark, root), NEWS_DAYS_WIDE)
    return latest.select(
        "company", "id", "published_at", "title", "sentiment",
        F.col("recency_rank").cast("long").alias("recency_rank"),
        S.short_time_label(F.col("published_at")).alias("time_text"),
    )


@query
def news_sentiment(spark, root):
    return _sentiment_columns(news.sentiment_block(T.news_items(spark, root), T.latest_event(spark, root)))


def _sentiment_columns(block: DataFrame) -> DataFrame:
    counts = [F.col(f"aggregate.{c.upper()}").alias(c) for c in SENTIMENTS]
    ratios = [f"aggregate.{c}_ratio" for c in SENTIMENTS]
    flat = block.select("*", *counts, *ratios).drop("aggregate")
    return _rounded(
        flat, "positive_ratio", "negative_ratio", "neutral_ratio", "news_sentiment_score",
        "sentiment_volatility", "recency_weight_mean",
    )


@query
def news_display(spark, root):
    items, asof = T.news_items(spark, root), T.latest_event(spark, root)
    return news.display(news.sentiment_block(items, asof, NEWS_DAYS_WIDE))


@query
def weekly_sentiment(spark, root):
    return news.weekly_sentiment(T.news_items(spark, root))


@query
def link_host(spark, root):
    return news.link_hosts(T.links(spark, root))


# --- financials -------------------------------------------------------------

@query
def financial_ratios(spark, root):
    return _rounded(financials.ratios(T.yearly_statements(spark, root)), *RATIOS)


def _latest_metrics(spark: SparkSession, root: str) -> DataFrame:
    return financials.latest_period(financials.ratios(T.yearly_statements(spark, root)))


@query
def metrics_latest(spark, root):
    return _rounded(_latest_metrics(spark, root), *RATIOS)


@query
def metrics_year(spark, root):
    """One year of ratios; the scan reads it and the year before for the growth."""
    statements = T.yearly_statements(spark, root, YEAR - 1, YEAR)
    return _rounded(financials.of_year(financials.ratios(statements), YEAR), *RATIOS)


@query
def metrics_years(spark, root):
    """Ratios stored by year, for the years in which urgent orders were placed since 1997."""
    path = shared_dir(spark, "metrics")
    metrics_store.save(financials.ratios(T.yearly_statements(spark, root)), path)
    rows = metrics_store.of_years(metrics_store.read(spark, path), T.order_years(spark, root, 1997))
    return _rounded(rows.select("company", "fiscal_year", *RATIOS), *RATIOS)


@query
def metrics_requested(spark, root):
    """All periods, as percentages, of the suppliers with small balances."""
    ratios = financials.ratios(T.yearly_statements(spark, root))
    return financials.request_metrics(ratios, T.small_suppliers(spark, root), all_periods=True, percent_format=True)


@query
def ratio_readback(spark, root):
    """Ratios read back from the percentages they are printed as."""
    shown = financials.displayed(financials.ratios(T.yearly_statements(spark, root)), missing="null")
    return shown.select("company", "fiscal_year", *[S.parse_percentage(F.col(r)).alias(r) for r in RATIOS])


@query
def ratio_display(spark, root):
    return financials.displayed(financials.ratios(T.yearly_statements(spark, root)))


@query
def quarterly_trend(spark, root):
    return _rounded(
        financials.quarterly_trend(T.quarterly_statements(spark, root)), "profit", "cashflow"
    )


@query
def quarterly_debt_ratio(spark, root):
    return _rounded(financials.quarterly_debt_ratio(T.quarterly_statements(spark, root)), "ratio")


@query
def market_dominance(spark, root):
    return _rounded(
        financials.market_dominance(T.quarterly_statements(spark, root)),
        "dominance", "competitor_gap",
    )


@query
def period_change(spark, root):
    ratio = financials.quarterly_debt_ratio(T.quarterly_statements(spark, root))
    return _rounded(
        financials.period_change(ratio, "ratio"),
        "ratio", "qoq_points", "qoq_rate", "yoy_points", "yoy_rate",
    )


@query
def risk_indicators(spark, root):
    return _rounded(
        financials.risk_indicators(T.quarterly_statements(spark, root)), "value", "change_points"
    )


@query
def series_unpivot(spark, root):
    trend = financials.quarterly_trend(T.quarterly_statements(spark, root))
    series = financials.unpivot(trend, ["company", "quarter_start"], ["profit", "cashflow"])
    return _rounded(series, "value")


@query
def link_base(spark, root):
    """Page addresses as bases to build request addresses on."""
    return T.links(spark, root).select("page_id", S.strip_trailing_slash(F.col("link")).alias("base"))


# --- features ---------------------------------------------------------------

def _scores(spark: SparkSession, root: str) -> DataFrame:
    return features.nonfinancial_scores(T.nonfinancial(spark, root))


@query
def nonfin_score(spark, root):
    return _rounded(_scores(spark, root), "final_score")


@query
def public_rating_lookup(spark, root):
    """Public rating of the company behind every add request."""
    requests = T.add_requests(spark, root).select("request_id", "name")
    return features.rating_lookup(requests, T.public_ratings(spark, root).select("name", "rating"))


@query
def rating_responses(spark, root):
    """The same from the rating service's answer to each request, looked up by name."""
    requests = T.add_requests(spark, root).select("request_id", "name")
    rated = requests.join(T.public_ratings(spark, root).select("name", "rating"), "name", "left")
    answers = rated.select("request_id", "name", F.to_json(F.struct(F.create_map("name", "rating").alias("ratings"))).alias("body"))
    return answers.select("request_id", "name", responses.rating_of(F.col("body"), F.col("name")).alias("public_rating"))


def _ratings(spark: SparkSession, root: str) -> DataFrame:
    return T.public_ratings(spark, root).select("company", "rating")


def _feature_sources(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    block = news.sentiment_block(T.news_items(spark, root), T.latest_event(spark, root))
    return _latest_metrics(spark, root), _ratings(spark, root), block, _scores(spark, root)


@query
def feature_ready(spark, root):
    return features.readiness(T.companies(spark, root), *_feature_sources(spark, root))


@query
def feature_assembly(spark, root):
    return _assembled(_feature_sources(spark, root))


def _assembled(sources: tuple[DataFrame, DataFrame, DataFrame, DataFrame]) -> DataFrame:
    return _rounded_features(features.assemble(*sources))


def _rounded_features(rows: DataFrame) -> DataFrame:
    return _rounded(
        rows, "news_sentiment_score", "sentiment_volatility", "positive_ratio", "negative_ratio",
        "recency_weight_mean", "business_report_text_score",
    )


def _response_bodies(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Response texts of the four services, a ``body`` each, as the services send them."""
    def body(of: DataFrame, **fields: Column) -> DataFrame:
        return of.select(F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()])).alias("body"))

    metrics, ratings, block, scores = _feature_sources(spark, root)
    code = F.col("company").cast("string")
    values = [c for c in block.columns if c != "company"]
    return {
        "metrics": body(metrics, data=F.array(F.struct(code.alias("stock_code"), *RATIOS))),
        "rating": body(ratings.filter("company IS NOT NULL"), ratings=F.create_map(code, "rating")),
        "news": body(block, results=F.array(F.struct(code.alias("query"), *values))),
        "score": body(scores, results=F.array(F.struct(code.alias("company"), F.struct("final_score").alias("score")))),
    }


@query
def feature_responses(spark, root):
    """The assembly from response texts: written as the services send them, read back."""
    bodies = _response_bodies(spark, root)

    def known(of: DataFrame, name: str) -> DataFrame:
        return of.withColumn("company", F.col(name).try_cast("bigint"))

    return _assembled((
        known(responses.first_metrics(bodies["metrics"]), "stock_code"),
        known(responses.credit(bodies["rating"]), "name").select("company", "rating"),
        known(responses.news_blocks(bodies["news"]), "query"),
        features.nonfinancial_scores(known(responses.nonfinancial(bodies["score"]), "company")),
    ))


@query
def unreadable_responses(spark, root):
    """The same bodies with one cut off beside each: how many of each service can be read."""
    whole = None
    for source, bodies in _response_bodies(spark, root).items():
        rows = bodies.select(F.lit(source).alias("source"), "body")
        whole = rows if whole is None else whole.unionByName(rows)
    cut = whole.withColumn("body", F.expr("left(body, length(body) - 1)"))
    mixed = written(whole.unionByName(cut), "mixed-responses")
    read = responses.readable(mixed).groupBy("source").agg(F.count(F.lit(1)).alias("n_read"))
    broken = responses.unreadable(mixed).groupBy("source", "reason").agg(F.count(F.lit(1)).alias("n_unreadable"))
    return read.join(broken, "source").select("source", "reason", "n_read", "n_unreadable")


def feature_snapshots(spark: SparkSession, root: str) -> DataFrame:
    """The 15 feature columns per company and day of news; only the news moves by day."""
    daily = news.daily_blocks(T.news_items(spark, root))
    rated = _ratings(spark, root).filter("rating IS NOT NULL")
    joined = (
        _latest_metrics(spark, root)
        .select("company", *[S.stored_ratio(F.col(r)).alias(r) for r in RATIOS])
        .join(rated.withColumnRenamed("rating", "public_credit_rating"), "company")
        .join(
            _scores(spark, root).withColumnRenamed("final_score", "business_report_text_score"),
            "company",
        )
        .join(daily.select("*", "aggregate.positive_ratio", "aggregate.negative_ratio"), "company")
    )
    return joined.select("snapshot_ts", *FEATURE_TYPES)


@query
def feature_changes(spark, root):
    return _feature_change_columns(features.changed(feature_snapshots(spark, root)))


def _feature_change_columns(kept: DataFrame) -> DataFrame:
    """What is saved, in the sink's columns and types, with the snapshot's time."""
    saved = feature_columns(kept, "snapshot_ts")
    return _rounded(
        saved, "news_sentiment_score", "sentiment_volatility", "positive_ratio", "negative_ratio",
        "recency_weight_mean", "business_report_text_score",
    )


# --- alerts -----------------------------------------------------------------

def _alerts(spark: SparkSession, root: str) -> DataFrame:
    return alerts.rating_alerts(T.grade_observations(spark, root), T.news_items(spark, root))


def _delivered(spark: SparkSession, root: str) -> DataFrame:
    return _alerts(spark, root).withColumn("inbox", F.col("company") % 10)


def _inbox(spark: SparkSession, root: str) -> DataFrame:
    return alerts.mark_read(_delivered(spark, root), T.read_receipts(spark, root))


@query
def rating_alerts(spark, root):
    return _alerts(spark, root)


@query
def news_warnings(spark, root):
    """Warnings against a grade that moves seldom; weeks without a move are common."""
    return alerts.news_warnings(T.value_observations(spark, root), T.news_items(spark, root))


@query
def notification_mark_read(spark, root):
    return _inbox(spark, root).select("id", "inbox", "type", "is_read")


@query
def notification_summary(spark, root):
    return alerts.summary(_inbox(spark, root))


@query
def notification_view(spark, root):
    return alerts.view(_inbox(spark, root))


@query
def notification_ordinal(spark, root):
    feed = _delivered(spark, root).select("inbox", "id", "ts")
    return alerts.newest_first(alerts.with_ordinal(feed))


# --- streams ----------------------------------------------------------------
# Each runs its stream over the whole event table and returns what the sink holds.

@query
def stream_credit_buckets(spark, root):
    rows = flows.run_available(flows.BUCKETS, shared_dir(spark, "buckets"), observation_stream(spark, root))
    return rows.select("company", "bucket_start", "score", S.grade_label(F.col("score")).alias("label"))


@query
def stream_weekly_sentiment(spark, root):
    return flows.run_available(flows.WEEKLY_SENTIMENT, shared_dir(spark, "weeks"), item_stream(spark, root))


def _followed(spark: SparkSession, root: str) -> DataFrame:
    return flows.run_available(flows.CHANGES, shared_dir(spark, "followed"), observation_stream(spark, root))


@query
def stream_grade_direction(spark, root):
    return grades.described(_followed(spark, root)).select(
        "company", "id", "ts", "grade", "score", "direction", "last_change"
    )


def _warned(spark: SparkSession, root: str, observations: DataFrame) -> DataFrame:
    return flows.run_available(flows.WARNINGS, shared_dir(spark, "warned"), observations, item_stream(spark, root))


@query
def stream_rating_alerts(spark, root):
    """All three types: moves from the followed grades, warnings from the weeks. The two
    streams run side by side."""
    moves, weeks = shared_dir(spark, "followed"), shared_dir(spark, "warned")
    running = [
        flows.start(flows.CHANGES, moves, observation_stream(spark, root), available_now=True),
        flows.start(flows.WARNINGS, weeks, observation_stream(spark, root), item_stream(spark, root), available_now=True),
    ]
    for stream in running:
        stream.awaitTermination()
    warnings = flows.served(spark, flows.WARNINGS, weeks)
    return flows.alerts_of(flows.served(spark, flows.CHANGES, moves)).unionByName(warnings)


@query
def stream_news_warnings(spark, root):
    """Warnings against a grade that moves seldom."""
    return _warned(spark, root, value_stream(spark, root))


@query
def stream_news_sentiment(spark, root):
    """The sentiment block at the last event, from the latest articles of each company."""
    rows = flows.run_available(flows.NEWS_BLOCKS, shared_dir(spark, "news"), item_stream(spark, root))
    return _sentiment_columns(rows)


@query
def stream_feature_changes(spark, root):
    """Feature snapshots as a table that a stream reads and saves the changes of."""
    path = shared_dir(spark, "snapshots")
    snapshots = feature_snapshots(spark, root)
    snapshots.write.parquet(path)
    arriving = spark.readStream.schema(snapshots.schema).parquet(path)
    flow = flows.features_flow(snapshots.schema)
    return _feature_change_columns(flows.run_available(flow, shared_dir(spark, "features"), arriving))


@query
def stream_feature_rows(spark, root):
    """Feature rows as soon as all four services have spoken: their responses are stored
    by two polls, each polled once, and the rows that are ready go to the feature sink."""
    stored, out = shared_dir(spark, "responses"), shared_dir(spark, "feature-rows")
    bodies = _response_bodies(spark, root)
    for number, sources in enumerate((("metrics", "score"), ("rating", "news"))):
        rows = [bodies[s].select(F.lit(s).alias("source"), "body") for s in sources]
        polled.store(rows[0].unionByName(rows[1]), stored, number)
        ready = flows.ready_features(polled.stream(spark, stored))
        feature_sink.start(ready, f"{out}/sink", f"{out}/checkpoint", available_now=True).awaitTermination()
    schema = f"{FEATURES}, ready BOOLEAN, version BIGINT"
    return _rounded_features(flows.served_features(feature_sink.read(spark, f"{out}/sink", schema)))

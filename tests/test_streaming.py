"""Streams over several files and restarts against the batch operators."""

import os
import subprocess
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from solvenza.operators import alerts, features, grades, news
from solvenza.sources import feature_sink, polled, responses, tables as T
from solvenza.session import by_value
from solvenza.streaming import flows, inputs, processors

FOLDER = "/root/testdata/sf0.001"
PARTS = 5


@pytest.fixture(scope="module")
def arrivals(spark, tmp_path_factory):
    """The events cut by time into files that arrive in that order."""
    folder = str(tmp_path_factory.mktemp("arrivals"))
    events = T.table(spark, FOLDER, "events").toPandas().sort_values("ts", ignore_index=True)
    size = len(events) // PARTS + 1
    for i in range(PARTS):
        part = events.iloc[i * size:(i + 1) * size]
        spark.createDataFrame(part, T.table(spark, FOLDER, "events").schema).coalesce(1).write.parquet(
            os.path.join(folder, f"part{i}")
        )
    return folder


def deliver(arrivals, inbox, i):
    """Put the files of one part into the streamed folder, named so they match."""
    part = os.path.join(arrivals, f"part{i}")
    for name in os.listdir(part):
        if name.endswith(".parquet"):
            with open(os.path.join(part, name), "rb") as source, open(os.path.join(inbox, f"events-{i}.parquet"), "wb") as to:
                to.write(source.read())


def run_in_parts(spark, arrivals, tmp_path, flow, order=range(PARTS), sources=(inputs.observation_stream,)):
    """One restart of the stream for each arriving file."""
    inbox, out = str(tmp_path / "inbox"), str(tmp_path / "out")
    os.makedirs(inbox)
    for i in order:
        deliver(arrivals, inbox, i)
        rows = flows.run_available(flow, out, *[source(spark, inbox) for source in sources])
    return rows


CHANGE_COLUMNS = ["company", "id", "ts", "grade", "score", "direction", "last_change"]


def same_changes(spark, followed):
    got = grades.described(followed).select(CHANGE_COLUMNS)
    expected = grades.with_changes(T.grade_observations(spark, FOLDER)).select(CHANGE_COLUMNS)
    assert sorted(got.collect()) == sorted(expected.collect())


def same_buckets(spark, rows):
    expected = grades.credit_buckets(T.grade_observations(spark, FOLDER))
    got = rows.select("company", "bucket_start", "score")
    assert sorted(got.collect()) == sorted(expected.drop("label").collect())


ORDERS = pytest.mark.parametrize("order", [range(PARTS), range(PARTS - 1, -1, -1), (2, 0, 4, 1, 3)])


@ORDERS
def test_buckets_equal_batch_in_any_order(spark, arrivals, tmp_path, order):
    same_buckets(spark, run_in_parts(spark, arrivals, tmp_path, flows.BUCKETS, order))


@ORDERS
def test_changes_equal_batch_in_any_order(spark, arrivals, tmp_path, order):
    followed = run_in_parts(spark, arrivals, tmp_path, flows.CHANGES, order)
    same_changes(spark, followed)
    ups_and_downs = alerts.grade_alerts(T.grade_observations(spark, FOLDER))
    assert sorted(flows.alerts_of(followed).collect()) == sorted(ups_and_downs.collect())


def test_weekly_sentiment_equals_batch(spark, arrivals, tmp_path):
    got = run_in_parts(spark, arrivals, tmp_path, flows.WEEKLY_SENTIMENT, (3, 1, 0, 2, 4), (inputs.item_stream,))
    assert sorted(got.collect()) == sorted(news.weekly_sentiment(T.news_items(spark, FOLDER)).collect())


def test_warnings_equal_batch(spark, arrivals, tmp_path):
    sources = inputs.value_stream, inputs.item_stream
    got = run_in_parts(spark, arrivals, tmp_path, flows.WARNINGS, (3, 1, 0, 2, 4), sources)
    expected = alerts.news_warnings(T.value_observations(spark, FOLDER), T.news_items(spark, FOLDER))
    assert sorted(got.collect()) == sorted(expected.collect()) != []


@ORDERS
def test_news_block_equals_batch_in_any_order(spark, arrivals, tmp_path, order):
    got = run_in_parts(spark, arrivals, tmp_path, flows.NEWS_BLOCKS, order, (inputs.item_stream,))
    asof = T.latest_event(spark, FOLDER)
    expected = news.sentiment_block(T.news_items(spark, FOLDER), asof)
    assert sorted(got.select(expected.columns).collect()) == sorted(expected.collect())


@pytest.fixture(scope="module")
def by_user(spark, tmp_path_factory):
    """The event table as a folder of part files, cut by user."""
    root = str(tmp_path_factory.mktemp("by_user"))
    events = T.table(spark, FOLDER, "events")
    for i in range(PARTS):
        events.filter(F.col("user_id") % PARTS == i).coalesce(1).write.mode("append").parquet(f"{root}/events.parquet")
    return root


def test_a_folder_table_one_file_a_batch(spark, by_user, tmp_path):
    stream = inputs.observation_stream(spark, by_user, files_per_trigger=1)
    same_buckets(spark, flows.run_available(flows.BUCKETS, str(tmp_path / "b"), stream))
    stream = inputs.observation_stream(spark, by_user, files_per_trigger=1)
    same_changes(spark, flows.run_available(flows.CHANGES, str(tmp_path / "c"), stream))


def test_a_repeated_batch_counts_once(spark, arrivals, tmp_path):
    """A micro-batch whose end the checkpoint does not know of, as after a failure."""
    inbox, out = str(tmp_path / "inbox"), str(tmp_path / "out")
    os.makedirs(inbox)
    for flow, name, same in ((flows.CHANGES, "c", same_changes), (flows.BUCKETS, "b", same_buckets)):
        for i in range(PARTS):
            deliver(arrivals, inbox, i)
            flows.run_available(flow, f"{out}/{name}", inputs.observation_stream(spark, inbox))
        commits = f"{out}/{name}/checkpoint/commits"
        last = max((n for n in os.listdir(commits) if n.isdigit()), key=int)
        os.remove(f"{commits}/{last}")
        if os.path.exists(f"{commits}/.{last}.crc"):
            os.remove(f"{commits}/.{last}.crc")
        same(spark, flows.run_available(flow, f"{out}/{name}", inputs.observation_stream(spark, inbox)))


KINDS = "company BIGINT, id BIGINT, ts TIMESTAMP_NTZ, grade STRING, news_keywords STRING"


def observed(spark, *rows):
    made = spark.createDataFrame([(c, i, None, g, "k", t) for c, i, t, g in rows], KINDS + ", t STRING")
    return made.withColumn("ts", F.col("t").cast("timestamp_ntz")).drop("t")


def arriving(spark, inbox, rows):
    """A stream of observations that stand in files, after one more."""
    observed(spark, *rows).coalesce(1).write.mode("append").parquet(inbox)
    return spark.readStream.schema(KINDS).parquet(inbox)


def test_a_late_row_is_put_in_its_place(spark, tmp_path):
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")
    for i, time, grade in [(1, "10:00", "AA"), (2, "09:00", "A"), (3, "11:00", "AA"), (4, "09:30", "NR")]:
        stream = arriving(spark, inbox, [(1, i, f"2024-01-01 {time}:00", grade)])
        rows = flows.run_available(flows.CHANGES, out, stream)
    rows = grades.described(rows).orderBy("ts").collect()
    assert [(r.id, r.direction, r.last_change) for r in rows] == [
        (2, "유지", ""), (1, "상향", "A → AA"), (3, "유지", "A → AA")
    ]


def state_rows(query):
    return [s["numRowsTotal"] for p in query.recentProgress for s in p["stateOperators"]]


def test_windows_go_after_180_days(spark, tmp_path):
    """Rows late by less than that still count; older ones change nothing, and the state
    ends with the watermark."""
    inbox, out, seen = str(tmp_path / "in"), str(tmp_path / "out"), []
    days = ["2024-01-01", "2024-01-02", "2024-06-20", "2024-01-03", "2024-08-01", "2024-01-04", "2024-08-02"]
    for i, day in enumerate(days):
        stream = arriving(spark, inbox, [(1, i, f"{day} 10:00:00", "AA"), (2, 100 + i, f"{day} 10:00:00", "A")])
        query = flows.start(flows.BUCKETS, out, stream, available_now=True)
        query.awaitTermination()
        seen.append(state_rows(query)[-1])
    # The late row of January 3 is taken in in June; by August the watermark is past it.
    assert seen[:4] == [2, 4, 6, 8] and seen[-1] == 6
    rows = spark.read.schema(flows.BUCKETS.schema).parquet(f"{out}/rows")
    assert {r.bucket_start.strftime("%m-%d") for r in rows.collect()} == {d[5:] for d in days} - {"01-04"}
    kept = flows.served(spark, flows.BUCKETS, out)
    assert {r.bucket_start.strftime("%m-%d") for r in kept.collect()} == {"06-20", "08-01", "08-02"}


def test_news_state_ends_with_its_days(spark, tmp_path):
    inbox, out, seen = str(tmp_path / "in"), str(tmp_path / "out"), []
    schema = "company BIGINT, id BIGINT, title STRING, published_at TIMESTAMP_NTZ, sentiment STRING"
    for i, (company, day) in enumerate([(1, 1), (2, 2), (3, 9), (3, 10)]):
        row = spark.createDataFrame([(company, i, "t", f"2024-01-{day:02} 00:00:00", "negative")], schema.replace("TIMESTAMP_NTZ", "STRING"))
        row.withColumn("published_at", F.col("published_at").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(inbox)
        query = flows.start(flows.NEWS_BLOCKS, out, spark.readStream.schema(schema).parquet(inbox), available_now=True)
        query.awaitTermination()
        newest = flows.newest(spark.read.schema(flows.NEWS_BLOCKS.schema).parquet(f"{out}/rows"), "company")
        seen.append({r.company: len(r.at) for r in newest.collect()})
    assert seen[1] == {1: 1, 2: 1} and seen[-1] == {1: 0, 2: 0, 3: 2}
    assert [r.company for r in flows.served(spark, flows.NEWS_BLOCKS, out).collect()] == [3]


def test_an_empty_source_serves_nothing(spark, tmp_path):
    T.table(spark, FOLDER, "events").limit(0).write.parquet(str(tmp_path / "events.parquet"))
    for name, flow in (("c", flows.CHANGES), ("b", flows.BUCKETS)):
        stream = inputs.observation_stream(spark, str(tmp_path))
        assert flows.run_available(flow, str(tmp_path / name), stream).collect() == []


def test_features_are_written_when_their_key_changes(spark, tmp_path):
    from test_features import CHANGED, SNAPSHOTS, days, snapshots

    inbox, schema = str(tmp_path / "inbox"), snapshots(spark, SNAPSHOTS).schema
    for part in (SNAPSHOTS[2:5], SNAPSHOTS[:2], SNAPSHOTS[5:]):   # the second comes late
        snapshots(spark, part).coalesce(1).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(schema).parquet(inbox)
        rows = flows.run_available(flows.features_flow(schema), str(tmp_path / "out"), stream)
    assert days(rows.collect()) == CHANGED
    assert days(features.changed(snapshots(spark, SNAPSHOTS)).collect()) == CHANGED


def test_poll_interval():
    assert inputs.poll() == {"processingTime": "3 minutes"}
    assert inputs.poll(available_now=True) == {"availableNow": True}


# --- polled responses and the feature sink -----------------------------------------

BODIES = {
    "metrics": '{"data":[{"stock_code":"%d","debt_ratio":0.5,"roa":null},{"stock_code":"9","roa":1}]}',
    "rating": '{"ratings":{"%d":"AA"}}',
    "news": '{"results":[{"query":"%d","news_count":2,"news_sentiment_score":0.5,"aggregate":{"positive_ratio":1.0}}]}',
    "score": '{"results":[{"company":"%d","score":{"final_score":0.75}}]}',
}


def store(spark, path, poll, *said):
    rows = [(source, text if "%" not in text else text % 1) for source, text in said]
    polled.store(spark.createDataFrame(rows, "source STRING, body STRING"), path, poll)


def test_each_poll_is_read_once(spark, tmp_path):
    stored, out = str(tmp_path / "stored"), str(tmp_path / "out")
    for poll in range(3):
        store(spark, stored, poll, *[("rating", f"body {poll} {i}\nwith é") for i in range(4)])
        if poll == 1:
            continue    # two polls at once the next time
        query = polled.stream(spark, stored).writeStream.format("parquet").option("path", out).option(
            "checkpointLocation", out + "-c").trigger(availableNow=True).start()
        query.awaitTermination()
        rows = spark.read.parquet(out).collect()
        assert sorted((r.poll, r.body) for r in rows) == [
            (p, f"body {p} {i}\nwith é") for p in range(poll + 1) for i in range(4)]


def test_a_poll_that_is_not_complete_waits(spark, tmp_path):
    store(spark, str(tmp_path), 0, ("rating", "a"))
    store(spark, str(tmp_path), 1, ("rating", "b"))
    os.remove(tmp_path / "poll=1" / "_SUCCESS")
    reader = polled.PollReader(str(tmp_path))
    assert reader.initialOffset() == {"polls": 0} and reader.latestOffset() == {"polls": 1}
    parts = reader.partitions({"polls": 0}, {"polls": 1})
    assert [r for p in parts for r in reader.read(p)] == [(0, "rating", "a")]


def test_what_responses_say(spark):
    rows = [(0, s, b % 1) for s, b in BODIES.items()] + [
        (1, "rating", '{"ratings":{"2":"-","3":"","x":"AA"}}'), (1, "score", '{"results":[{"company":"2","score":{"final_score":"1"}}]}'),
        (1, "metrics", "{broken"), (1, "news", None), (1, "other", "{}"), (1, "metrics", '{"data":[]}')]
    got = responses.said(spark.createDataFrame(rows, polled.SCHEMA)).collect()
    assert {(r.company, r.source) for r in got if r.payload} == {(1, s) for s in responses.SOURCES}
    assert {(r.company, r.source) for r in got if not r.payload} == {(2, "rating"), (3, "rating"), (2, "score")}


def test_features_are_told_when_the_fourth_source_arrives(spark, tmp_path):
    stored, sink = str(tmp_path / "stored"), str(tmp_path / "sink")
    schema = "company BIGINT, debt_ratio DOUBLE, roa DOUBLE, public_credit_rating STRING, ready BOOLEAN, version BIGINT"
    told = []
    sequence = [["metrics", "rating"], ["score"], ["news"], ["rating"]]
    for poll, sources in enumerate(sequence):
        said = [(s, BODIES[s] if poll < 3 else '{"ratings":{"%d":"A"}}') for s in sources]
        store(spark, stored, poll, *said)
        rows = flows.ready_features(polled.stream(spark, stored))
        feature_sink.start(rows, sink, str(tmp_path / "c"), available_now=True).awaitTermination()
        told.append([(r.company, r.debt_ratio, r.roa, r.public_credit_rating)
                     for r in flows.served_features(feature_sink.read(spark, sink, schema)).collect()])
    assert told == [[], [], [(1, 0.5, 0.0, "AA")], [(1, 0.5, 0.0, "A")]]


def batch_of(*values):
    import pyarrow as pa
    return iter([pa.RecordBatch.from_pydict({"company": list(values)})]) if values else iter([])


def test_sink_notes_a_batch_once(spark, tmp_path):
    path = str(tmp_path)

    def companies():
        return sorted(r.company for r in feature_sink.read(spark, path, "company BIGINT").collect())

    writer = feature_sink.FeatureWriter(path)
    assert companies() == []
    writer.commit([writer.write(batch_of(1, 2)), writer.write(batch_of()), None], 0)
    writer.commit([writer.write(batch_of(1, 2))], 0)            # the batch again
    lost = writer.write(batch_of(3))                             # a task of a batch that fails
    writer.abort([lost, None, feature_sink.Written(None)], 1)
    writer.write(batch_of(4))                                    # a task that is lost after writing
    writer.commit([writer.write(batch_of(5))], 1)
    assert companies() == [1, 2, 5]
    assert not os.path.exists(f"{path}/rows/{lost.file}")


def test_keyed_state_on_any_session(spark, tmp_path):
    """A query gets the store that it needs, and the session keeps its own."""
    name, other = "spark.sql.streaming.stateStore.providerClass", (
        "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    before = spark.conf.get(name)
    spark.conf.set(name, other)
    try:
        stream = inputs.observation_stream(spark, FOLDER)
        same_changes(spark, flows.run_available(flows.CHANGES, str(tmp_path), stream))
        assert spark.conf.get(name) == other
    finally:
        spark.conf.set(name, before)


@pytest.mark.parametrize("made", [
    processors.Follow(1), processors.Sources(("a",)), polled.PollReader("x"), polled.ResponseFile(0, "x"),
    feature_sink.FeatureWriter("x"), feature_sink.Written(None),
])
def test_what_the_drivers_processes_load_brings_its_code(made, tmp_path):
    by_value(processors.__name__, polled.__name__, feature_sink.__name__)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    load = "import pickle, sys; print(type(pickle.loads(sys.stdin.buffer.read())).__name__)"
    done = subprocess.run([sys.executable, "-c", load], input=cloudpickle.dumps(made), capture_output=True, cwd=tmp_path, env=env)
    assert done.stdout.decode().strip() == type(made).__name__, done.stderr.decode()[-2000:]

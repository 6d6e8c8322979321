import datetime as dt

import pytest
from pyspark.sql import functions as F

from solvenza import session
from solvenza.operators import catalog, grades
from solvenza.sources import stored, tables as T

FOLDER = "/root/testdata/sf0.001"


def test_stored_catalog(spark, tmp_path):
    rows = [("KB금융", "금융", None), ("3S", "제조", None)]
    spark.createDataFrame(rows, stored.ENTITIES["catalog"]).write.parquet(str(tmp_path / "c"))
    companies = stored.read(spark, "catalog", str(tmp_path / "c"))
    assert [r.name for r in catalog.search(companies, "kb").collect()] == ["KB금융"]


def test_stored_observations_as_json_and_as_a_stream(spark, tmp_path):
    path = str(tmp_path / "o")
    rows = [(1, 1, dt.datetime(2024, 1, 1), "AA")]
    spark.createDataFrame(rows, stored.ENTITIES["grade_observations"]).write.json(path)
    assert grades.directions(stored.read(spark, "grade_observations", path, "json").withColumn("news_keywords", F.lit("k"))).count() == 1
    assert stored.stream(spark, "grade_observations", path, "json").isStreaming


def test_declared_schemas_match_the_tables(spark):
    for name in T.TABLES:
        declared, stored_as = T.table(spark, FOLDER, name), spark.read.parquet(f"{FOLDER}/{name}.parquet")
        assert declared.schema.simpleString() == stored_as.schema.simpleString()


def test_statements_are_exact(spark):
    """Integer sums equal decimal sums over the whole table."""
    got = T.yearly_statements(spark, FOLDER).agg(
        F.sum(F.rint(F.col("total_assets") * 100).cast("long")).alias("assets"),
        F.sum(F.rint(F.col("net_income") * 10000).cast("long")).alias("income"),
    ).first()
    price, discount = (F.col(c).cast("decimal(14,2)") for c in ("l_extendedprice", "l_discount"))
    exact = T.table(spark, FOLDER, "lineitem").agg(
        F.sum(price).alias("assets"), F.sum(price * discount).alias("income")
    ).first()
    assert (got.assets, got.income) == (int(exact.assets * 100), int(exact.income * 10000))


def test_year_bounds_leave_whole_years(spark):
    bounded = T.yearly_statements(spark, FOLDER, 1997, 1998)
    whole = T.yearly_statements(spark, FOLDER).filter("fiscal_year IN (1997, 1998)")
    assert sorted(bounded.collect()) == sorted(whole.collect())


def test_request_names_are_the_customers_names(spark):
    requests, names = T.add_requests(spark, FOLDER), T.catalog(spark, FOLDER)
    unknown = requests.join(names, "name", "left_anti").select("name").distinct()
    assert unknown.count() == T.table(spark, FOLDER, "supplier").count()


def test_shared_folder_comes_from_the_session(spark):
    root = spark.conf.get("spark.checkpoint.dir", None)
    one, two = session.shared_dir(spark, "x"), session.shared_dir(spark, "x")
    assert one != two
    if root:
        assert one.startswith(root)


def test_no_machine_local_folder_on_a_cluster():
    class Context:
        master = "spark://host:7077"

    class Conf:
        def get(self, key, default=None):
            return None

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError):
        session.shared_dir(Session(), "x")

import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from solvenza.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g",
    })
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Evaluate a column expression over one column of values, in order."""
    def evaluate(function, values, kind="string"):
        rows = list(enumerate(values))
        df = spark.createDataFrame(rows, f"i INT, v {kind}")
        return [r.out for r in df.select("i", function(df.v).alias("out")).orderBy("i").collect()]

    return evaluate

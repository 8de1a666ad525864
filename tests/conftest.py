import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from almanack import build_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", "local[8]", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "8g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture
def one(spark):
    """Evaluate a column rule on a list of tuples; returns the list of results."""

    def run(rows, schema, rule):
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"_i int, {schema}")
        return [r["out"] for r in df.select("_i", rule.alias("out")).orderBy("_i").collect()]

    return run

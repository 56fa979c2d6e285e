import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from curata.session import get_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = get_session("local[4]", "curata-tests", shuffle_partitions=4)
    yield s


@pytest.fixture()
def numbers(spark):
    """g string, i int, x double: nulls, NaN, zero, negatives, large values."""
    rows = [("a", 1, 1.0), ("a", 2, 2.5), ("a", None, None), ("a", 4, float("nan")),
            ("b", -3, -7.25), ("b", 0, 0.0), ("b", 10, 1e9), (None, 5, 3.0),
            ("c", 7, 42.0)]
    return spark.createDataFrame(rows, "g string, i int, x double")


def formatted_plan(df) -> str:
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from postlens import spark_session  # noqa: E402

DATA = "/root/testdata/sf0.001"
# started here, since test modules build column expressions when imported
SESSION = spark_session("tests", 4)


@pytest.fixture(scope="session")
def spark():
    return SESSION


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture
def column(spark):
    """Evaluate an expression over a list of texts."""
    def run(expression, texts, kind="string"):
        rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], f"i int, t {kind}")
        return [r[0] for r in rows.orderBy("i").select(expression).collect()]

    return run

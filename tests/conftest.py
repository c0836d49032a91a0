import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from scriptorium.session import local_session  # noqa: E402

# Started on import: test modules build column expressions at their top level.
SPARK = local_session(4, shuffle_partitions=4, memory="6g")


@pytest.fixture(scope="session")
def spark():
    yield SPARK
    SPARK.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture()
def value(spark):
    """Evaluate a column expression over one literal row."""

    def run(build, schema="text STRING", row=("x",)):
        return spark.createDataFrame([row], schema).select(build.alias("v")).first()["v"]

    return run

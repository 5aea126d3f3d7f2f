import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent.parent))

from roadloom.session import build_session, configure  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("roadloom-tests", master="local[4]", shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    session.stop()


@pytest.fixture(autouse=True)
def _no_cache_between_tests(spark):
    yield
    spark.catalog.clearCache()

import datetime as dt

import pytest

from wardcast.session import get_spark

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = get_spark("tests", "local[8]", **{
        "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "6g",
    })
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    return FOLDER


@pytest.fixture
def days():
    """A function giving consecutive dates."""
    def make(n, start=dt.date(2025, 1, 1)):
        return [start + dt.timedelta(days=i) for i in range(n)]

    return make

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from panelyard.session import build_session


@pytest.fixture(scope="session")
def spark():
    # Many small plans: quick compilation matters more than peak speed.
    session = build_session("tests", "8", {
        "spark.driver.extraJavaOptions": "-XX:TieredStopAtLevel=1",
        "spark.sql.shuffle.partitions": "4",
    })
    yield session
    session.stop()


@pytest.fixture(autouse=True)
def _no_cached_tables(spark):
    yield
    spark.catalog.clearCache()

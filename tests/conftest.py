import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pagemill.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def pages(spark):
    """Pages from (url, html) pairs, numbered from 1."""

    def build(*pairs):
        rows = [(n, url, html) for n, (url, html) in enumerate(pairs, 1)]
        return spark.createDataFrame(rows, "page_id long, url string, html string")

    return build

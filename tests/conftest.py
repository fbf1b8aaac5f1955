import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidemark.session import build_session, release_work  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", 4, shuffle_partitions=4, driver_memory="4g")
    yield session
    release_work(session)
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

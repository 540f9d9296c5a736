import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from lectern.session import session, ship  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = ship(session("local[4]", partitions=4, memory="4g"))
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"

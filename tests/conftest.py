import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from adloom.session import local_session  # noqa: E402
from adloom.streaming.ledger import STATE_STORE  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(cpus=4, memory="4g", app="adloom-tests")
    session.conf.set(*STATE_STORE)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF

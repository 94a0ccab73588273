import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from tabstat.session import local_session, prepare
    s = prepare(local_session("tabstat-tests", cores=8, partitions=8))
    yield s
    s.stop()

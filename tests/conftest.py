import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from docreason.session import build_session
    s = build_session(cores="*", shuffle_partitions=8, driver_memory="8g")
    yield s
    s.stop()


SF_SMALL = "/root/testdata/sf0.001"

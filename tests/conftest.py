import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from equiwatch.session import checkpoint_dir, get_session

    s = get_session("local[4]", 4)
    checkpoint_dir(s)  # local folder only because none is configured in tests
    yield s
    s.stop()

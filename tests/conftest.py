import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from timberline.runtime import local_session  # noqa: E402

DATA = os.environ.get("TIMBERLINE_TESTDATA", "/root/testdata")


@pytest.fixture(scope="session")
def spark():
    s = local_session(cpus=4, shuffle_partitions=4)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def tiny():
    d = f"{DATA}/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test tables here")
    return d

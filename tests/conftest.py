import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tools")]

from faultline.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(8, "faultline-tests", shuffle_partitions=4)

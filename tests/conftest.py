import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from faultline.session import checkpoint_root, get_session
    s = get_session("local[4]", app="faultline-tests", shuffle_partitions=4)
    checkpoint_root(s)
    yield s


@pytest.fixture()
def tmp_dir():
    return tempfile.mkdtemp(prefix="faultline-test-")

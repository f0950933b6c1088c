import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from buildlens.session import get_session
    s = get_session("local[4]", 4)
    s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="bl-test-ckpt-"))
    yield s
    s.stop()


@pytest.fixture()
def tmp_out():
    return tempfile.mkdtemp(prefix="bl-test-out-")

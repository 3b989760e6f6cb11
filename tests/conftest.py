import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

GOLDEN = os.path.join(os.path.dirname(os.path.abspath(__file__)), "golden")
SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from relscope.session import build_session
    extra = {}
    # Tests name their own shared folder only when the session names none.
    if not os.environ.get("SPARK_CHECKPOINT_DIR"):
        extra["spark.checkpoint.dir"] = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    s = build_session("local[4]", 8, "relscope-tests", extra)
    yield s


def golden(name):
    return os.path.join(GOLDEN, name)

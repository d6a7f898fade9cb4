import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from wattline.session import build_session, clear_scratch, scratch_root
    log = tempfile.mkdtemp(prefix="wattline-test-log-")
    s = build_session("local[4]", app="wattline-tests", shuffle_partitions=8, extra={
        "spark.eventLog.enabled": "true", "spark.eventLog.compress": "false", "spark.eventLog.dir": f"file:{log}"})
    s.sparkContext.setLogLevel("ERROR")
    scratch_root(s)  # sets a private checkpoint folder only if none is configured
    yield s
    clear_scratch(s)
    s.stop()

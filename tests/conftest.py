import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from ledgerscope.session import get_session
    scratch = tempfile.mkdtemp(prefix="ledgerscope-tests-", dir="/tmp")
    s = get_session("local[4]", 8, extra={
        "spark.ui.showConsoleProgress": "false",
        "spark.checkpoint.dir": os.path.join(scratch, "ckpt"),
    })
    yield s
    s.stop()


SF = "/root/testdata/sf0.001"

import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tabscope.session import get_session
    scratch = tempfile.mkdtemp(prefix="tabscope-test-")
    s = get_session("local[4]", shuffle_partitions=4,
                    extra={"spark.checkpoint.dir": os.path.join(scratch, "ckpt"), "spark.driver.memory": "4g"})
    yield s
    s.stop()


@pytest.fixture()
def scratch():
    return tempfile.mkdtemp(prefix="tabscope-case-")

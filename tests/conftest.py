import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from revwise.session import build_session
    with tempfile.TemporaryDirectory(prefix="revwise-warehouse-") as warehouse:
        s = build_session(master="local[*]", shuffle_partitions=8, app="revwise-tests",
                          extra={"spark.sql.warehouse.dir": warehouse})
        yield s
        s.stop()


@pytest.fixture()
def tmpdir_path():
    return tempfile.mkdtemp(prefix="revwise-test-")


SF = "/root/testdata/sf0.001"

import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from sluice.session import get_session
    ckpt = tempfile.mkdtemp(prefix="sluice-test-ckpt-")
    s = get_session("local[4]", 8, app_name="sluice-tests",
                    extra={"spark.checkpoint.dir": ckpt, "spark.sql.shuffle.partitions": "8"})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck001():
    from tests.compare_util import duck
    return duck(SF001)


@pytest.fixture(scope="session")
def duck01():
    from tests.compare_util import duck
    return duck(SF01)

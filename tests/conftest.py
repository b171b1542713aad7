import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from vigil.session import local_session
    s = local_session(4, shuffle_partitions=8, app="vigil-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def make_files(spark):
    from vigil.schemas import FILES

    def make(rows):
        return spark.createDataFrame(rows, FILES)
    return make

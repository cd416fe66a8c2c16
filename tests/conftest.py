import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from loglens.session import checkpoint_dir, local_session
    s = local_session("*", shuffle_partitions=8, app="loglens-tests")
    checkpoint_dir(s)          # uses spark.checkpoint.dir, or a fresh scratch folder locally
    yield s


@pytest.fixture()
def lines(spark):
    """Build a (path, line_no, line_text) DataFrame from Python tuples."""
    def make(rows):
        return spark.createDataFrame(rows, "path string, line_no bigint, line_text string")
    return make

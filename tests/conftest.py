import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from moodlake.session import checkpoint_root, get_session

    # spark.checkpoint.dir as configured; a private folder only when it is unset
    # plans are asserted on: their filters are not cut short, however long the attribute numbers have become
    s = get_session("local[4]", app="moodlake-tests", shuffle_partitions=4,
                    extra={"spark.sql.maxMetadataStringLength": "2000"})
    checkpoint_root(s)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()

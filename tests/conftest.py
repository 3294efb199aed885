import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from estuary.session import session

    s = session("local[4]", 4)
    s.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()

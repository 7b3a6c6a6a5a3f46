import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from leafmill.runtime import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session("tests", 4, **{"spark.sql.shuffle.partitions": "4", "spark.default.parallelism": "4"})
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from listenlab.session import build

    s = build("tests", 4, spark__sql__shuffle__partitions="4")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark():
    from fieldtide.session import get_session

    session = get_session("tests", "local[*]", 8)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()

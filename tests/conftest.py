import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    from versemill.session import get_session

    session = get_session("tests", 8, spark__sql__shuffle__partitions="4", spark__driver__memory="4g")
    yield session
    session.stop()

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    os.environ.setdefault("FOLIOFRAME_DRIVER_MEMORY", "6g")
    from folioframe.session import local_session

    session = local_session("4", "folioframe-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from harvestline.session import build_session, ship_package  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[8]", 4, spark__ui__enabled="false", spark__driver__memory="8g")
    session.sparkContext.setLogLevel("OFF")
    ship_package(session)
    yield session
    session.stop()

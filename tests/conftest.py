import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidemark.session import build_session


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", "local[4]", 4, spark__ui__enabled="false", spark__driver__memory="6g")
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()

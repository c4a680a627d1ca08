import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from textverk.session import build

    at = tmp_path_factory.mktemp("shared")
    s = build("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__checkpoint__dir=f"file://{at}", spark__ui__showConsoleProgress="false", spark__driver__memory="4g", spark__sql__warehouse__dir=str(at / "warehouse"))
    yield s
    s.stop()

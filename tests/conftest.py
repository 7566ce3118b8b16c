import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tamiz.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    shared = tempfile.mkdtemp(prefix="tamiz-tests-")
    session = local_session(
        8,
        "tests",
        spark__checkpoint__dir=f"{shared}/shared",
        spark__sql__warehouse__dir=f"{shared}/warehouse",
        spark__driver__memory="8g",
    )
    yield session
    session.stop()


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="tamiz-test-")

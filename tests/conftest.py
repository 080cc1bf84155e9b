import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from crumbtrail.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def folder():
    if not DATA.exists():
        pytest.skip("no test tables here")
    return str(DATA)

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from vellumine.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = tmp_path_factory.mktemp("shared")
    session = local_session(4, 4, spark__checkpoint__dir=f"file://{folder}", spark__driver__memory="3g")
    session.sparkContext.setLogLevel("ERROR")
    return session

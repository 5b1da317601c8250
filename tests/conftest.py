import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from ellipsa.session import local_session

    session = local_session(4, 4)
    session.sparkContext.environment.setdefault("PYTHONPATH", ROOT)
    session.sparkContext.setLogLevel("ERROR")
    return session

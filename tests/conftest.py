import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ.setdefault("RAYON_NUM_THREADS", "2")


@pytest.fixture(scope="session")
def spark():
    from vektra.session import local_session

    session = local_session(4, 4, "4g")
    yield session
    session.stop()

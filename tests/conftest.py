import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, os.environ.get("PYTHONPATH")) if x)


@pytest.fixture(scope="session")
def spark():
    from millrace.session import local_session

    session = local_session(8, 4)
    session.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="millrace-tests-"))
    yield session
    session.stop()

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from knotwork.session import local_session
    from knotwork.shipping import ship

    session = local_session(4, 4, "tests")
    ship(session)
    yield session
    session.stop()

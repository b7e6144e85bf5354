import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).parent.parent
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    from quadrille.session import local_session, ship

    s = local_session("tests", 4, 4)
    s.sparkContext.setLogLevel("ERROR")
    ship(s)
    return s

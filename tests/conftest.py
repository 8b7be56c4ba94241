import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from taxaloom import session


@pytest.fixture(scope="session")
def spark():
    s = session.build("4", 4, **{"spark.driver.memory": "4g"})
    yield s
    s.stop()

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [str(ROOT), os.environ.get("PYTHONPATH")]))
os.environ.setdefault("FOLIODIFF_DRIVER_MEMORY", "3g")


@pytest.fixture(scope="session")
def spark():
    from foliodiff.session import local_session

    return local_session(4, 4)

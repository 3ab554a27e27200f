"""One local session for all tests; tables of the smallest scale where they are present."""

from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
DATA = os.environ.get("BRINEFLOW_TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    os.environ.setdefault("BRINEFLOW_DRIVER_MEMORY", "6g")
    from brineflow.runtime.session import local_session

    session = local_session(4, 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def data() -> str:
    if not Path(DATA).exists():
        pytest.skip("no test tables here")
    return DATA

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from plumbline.sources.staging import drop_staged_tables  # noqa: E402
from tests.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session()
    yield session
    drop_staged_tables(session)
    session.stop()

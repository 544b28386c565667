import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from profilekit.session import clear_materialised, local_session, ship_package  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", shuffle_partitions=8, app="profilekit-tests")
    ship_package(session)
    yield session
    clear_materialised(session)
    session.stop()

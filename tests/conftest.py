import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from quarry.session import local_session, on_workers_path

    session = local_session("quarry-tests", cores=8, spark__sql__shuffle__partitions="4")
    on_workers_path(session)
    yield session
    session.stop()

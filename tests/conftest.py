import pytest

from tessellum.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", app="tests", **{"spark__sql__shuffle__partitions": "4"})
    yield session
    session.stop()

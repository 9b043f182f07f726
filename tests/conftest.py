import pytest

from tracklore.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores="4", memory="4g", app="tests")
    yield session
    session.stop()

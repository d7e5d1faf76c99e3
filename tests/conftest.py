import pytest

from crosswind.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(app="tests")
    yield session
    session.stop()

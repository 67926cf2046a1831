import pytest

from corpusloom.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("4", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session

import pytest

from nearpass import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[4]", 4, spark__driver__memory="4g", spark__ui__showConsoleProgress="false")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"

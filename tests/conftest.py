import pytest

from tests.oracle_check import make_session


@pytest.fixture(scope="session")
def spark():
    return make_session(4)

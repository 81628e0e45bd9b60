import pytest

from thicket.session import local_session, ship


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, "tests", spark__sql__shuffle__partitions="4")
    ship(s)
    return s

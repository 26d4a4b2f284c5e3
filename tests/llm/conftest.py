import pytest


@pytest.fixture(scope="session")
def sf(pytestconfig):
    return "/root/testdata/sf0.001"

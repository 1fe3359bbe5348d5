import pytest

from cairn.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("cairn-tests", cores="4", **{"spark.driver.memory": "4g"})
    yield session
    session.stop()

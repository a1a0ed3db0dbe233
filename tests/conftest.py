import tempfile

import pytest

from citescan.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores=4, memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    if not session.sparkContext.getCheckpointDir():
        session.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-tests-"))
    yield session
    session.stop()

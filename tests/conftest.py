"""One local session for all tests, with a checkpoint folder of its own."""

import pytest

from claimloom.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(cpus=4, partitions=4, memory="4g", app="tests")
    if not session.sparkContext.getCheckpointDir():
        session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield session
    session.stop()

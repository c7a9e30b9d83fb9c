import pytest

from tidemark.session import get_session


@pytest.fixture(scope="session")
def spark():
    s = get_session("tests", master="local[4]", partitions=3, spark__sql__autoBroadcastJoinThreshold="64k")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


DATA = "/root/testdata/sf0.001"

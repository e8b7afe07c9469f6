import pytest

from packetloom.session import get_spark
from packetloom.streaming.state import use_rocksdb


@pytest.fixture(scope="session")
def spark():
    session = get_spark(
        "packetloom-tests", master="local[4]", spark__ui__enabled="false", spark__sql__shuffle__partitions="4",
        spark__ui__showConsoleProgress="false",
    )
    session.sparkContext.setLogLevel("ERROR")
    use_rocksdb(session)
    yield session
    session.stop()

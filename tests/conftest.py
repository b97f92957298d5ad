"""One Spark session for all tests."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from linkloom.session import local_session

    shared = tmp_path_factory.mktemp("shared")
    own = {
        "spark.sql.warehouse.dir": str(shared / "warehouse"),
        "spark.checkpoint.dir": str(shared / "checkpoints"),
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    }
    session = local_session("8", 4, own)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()

"""One Spark session for all tests."""

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from cedarflow.session import build_session

    shared = tmp_path_factory.mktemp("shared")
    session = build_session("tests", master="local[4]", conf={
        "spark.sql.shuffle.partitions": "4",
        "spark.checkpoint.dir": f"file://{shared}",
        "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
        "spark.driver.memory": "3g",
    })
    yield session
    session.stop()

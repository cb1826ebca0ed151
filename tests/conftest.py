import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    from tidemark import build_session
    # The shared folder is named here, as a cluster names it.
    SparkSession.builder.config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
    session = build_session("tests", "local[4]", 4, "4g")
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    return "/root/testdata/sf0.001"

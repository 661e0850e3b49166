import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = sys.path[0] + ":" + os.environ.get("PYTHONPATH", "")

from stratalens.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    SparkSession.builder.config("spark.driver.memory", "8g").config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
    s = build_session("tests", "local[8]", 8)
    yield s
    s.stop()

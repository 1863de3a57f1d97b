import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from lakewright.session import build_session, drop_scratch  # noqa: E402

SMALL = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("tests", os.environ.get("TEST_MASTER", "local[8]"), **{
        "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "8g", "spark.ui.enabled": "false",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse"))})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    drop_scratch(session)
    session.stop()


@pytest.fixture(scope="session")
def now():
    def make(text="2024-02-01 00:00:00"):
        from pyspark.sql import functions as F
        return F.lit(text).cast("timestamp_ntz")
    return make

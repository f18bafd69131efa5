import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from dayglass import fixture_config  # noqa: E402
from dayglass.session import build_session  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[8]", spark__sql__shuffle__partitions="4",
                            spark__ui__showConsoleProgress="false", spark__driver__memory="6g",
                            spark__sql__streaming__stateStore__providerClass=
                            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def cfg():
    return fixture_config()


@pytest.fixture(scope="session")
def inputs(spark):
    from dayglass.plans.registry import Inputs

    return Inputs(spark, SF_DIR)

import os
import sys

import pytest

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.path.dirname(os.path.abspath(__file__))]

from scoutframe.session import build_session


@pytest.fixture(scope="session")
def spark():
    s = build_session(
        "tests", "local[8]",
        **{
            "spark.sql.shuffle.partitions": 8, "spark.driver.memory": "6g",
            "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        },
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()

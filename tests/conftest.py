from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from reagentql.session import session

    base = tmp_path_factory.mktemp("spark")
    s = session(
        "local[4]", 4, **{"spark.sql.warehouse.dir": str(base / "warehouse"), "spark.checkpoint.dir": str(base / "checkpoint"), "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false"}
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()

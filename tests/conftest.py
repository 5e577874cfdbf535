import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from icestats.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = str(tmp_path_factory.mktemp("shared"))
    s = build_session(
        "tests", "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "6g",
            "spark.checkpoint.dir": shared, "spark.sql.warehouse.dir": shared + "/warehouse",
            # small Arrow batches, so that groups run over several of them
            "spark.sql.execution.arrow.maxRecordsPerBatch": "64",
        },
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()

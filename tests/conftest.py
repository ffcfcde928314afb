import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from netpen.session import configure  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").appName("netpen-tests")
        .config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false")
        # Tiny tables: compiling stages would take longer than running them.
        .config("spark.sql.codegen.wholeStage", "false")
        .config("spark.driver.memory", "4g").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    session.stop()

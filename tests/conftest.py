import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from placewise.session import configure
    s = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "6g")
         .config("spark.sql.ui.retainedExecutions", "100000").getOrCreate())       # tests count what their own executions did, behind those of all others
    s.sparkContext.setLogLevel("ERROR")
    yield configure(s)
    s.stop()

import os

os.environ.setdefault("PYARROW_IGNORE_TIMEZONE", "1")

import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    top = tmp_path_factory.mktemp("spark")
    found = (
        SparkSession.builder.master("local[8]").appName("lumenframe-tests").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "6g").config("spark.sql.warehouse.dir", str(top / "warehouse"))
        .config("spark.checkpoint.dir", f"file://{top}/shared").getOrCreate()
    )
    found.sparkContext.setLogLevel("ERROR")
    yield found
    found.stop()

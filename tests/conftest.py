import pytest
from pyspark.sql import SparkSession

from quitanda.session import pin


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("spark")
    session = (SparkSession.builder.master("local[8]").appName("tests")
               .config("spark.sql.shuffle.partitions", "8")
               .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
               .config("spark.driver.memory", "6g")
               .config("spark.checkpoint.dir", str(shared / "checkpoints"))
               .config("spark.sql.warehouse.dir", str(shared / "warehouse"))
               .getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    return pin(session)


@pytest.fixture()
def rows(spark):
    """Build a frame from tuples and a DDL schema."""
    return lambda data, ddl: spark.createDataFrame(data, ddl)

import pytest

from postmill.runtime import session


@pytest.fixture(scope="session")
def spark():
    spark = session("tests", "local[4]", spark_sql_shuffle_partitions="4", spark_driver_memory="4g")
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()

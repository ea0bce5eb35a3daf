import pytest
from pyspark.sql import SparkSession

from casesignal.session import prepare


def make_spark() -> SparkSession:
    spark = (
        SparkSession.builder.master("local[8]")
        .appName("casesignal-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


@pytest.fixture(scope="session")
def spark():
    return make_spark()

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .appName("sparkclean-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.driver.memory", "6g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture()
def employees(spark):
    return spark.createDataFrame(
        [("Alice", 30.0, 50000.0, "2020-01-15"), ("Bob", None, 60000.0, "2019-06-01"),
         ("Charlie", 25.0, None, "2021-03-20"), ("Alice", 30.0, 50000.0, "2020-01-15"),
         (None, 28.0, 45000.0, "2022-11-30")],
        "Name string, Age double, Salary double, JoinDate string")


@pytest.fixture()
def departments(spark):
    return spark.createDataFrame([("Alice", "Eng"), ("Bob", "HR"), ("Charlie", "Eng")], "Name string, Dept string")


@pytest.fixture()
def sales(spark):
    return spark.createDataFrame(
        [("Alice Johnson", "$1,200.50", "2023-01-15", "West", "5"), ("Bob Smith", "$850.00", "01/22/2023", "East", "3"),
         ("Alice Johnson", "$1,200.50", "2023-01-15", "West", "5"), ("Carol White", None, "2023-02-10", "North", "2"),
         ("Dave Brown", "$3,400.00", "03/05/2023", None, "10"), ("Eve Davis", "$920.75", "2023-03-20", "South", "4")],
        "`Customer Name` string, `Sale Amount` string, `Sale Date` string, Region string, `Units Sold` string")

from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

SALES = """order_id,order_date,customer_name,region,category,revenue,units
1,2023-04-04,Quill,Harbor,Bread,260,20
2,2023-04-12,Moss,Hills,Cake,415,7
3,2023-04-13,Quill,Harbor,Cake,330,6
4,2023-04-27,Tansy,Valley,Bread,145,11
5,2023-05-03,Moss,Hills,Bread,205,16
6,2023-05-09,Quill,Harbor,Tea,95,4
7,2023-05-18,Reed,Valley,Cake,620,10
8,2023-05-30,Tansy,Valley,Tea,70,3
9,2023-06-05,Quill,Harbor,Cake,505,9
10,2023-06-14,Reed,Hills,Bread,390,30
11,2023-06-21,Moss,Hills,Tea,120,5
12,2023-07-06,Quill,Harbor,Bread,275,21
13,2023-07-11,Linden,Valley,Cake,880,14
14,2023-07-25,Reed,Hills,Tea,155,8
"""


@pytest.fixture(scope="session")
def spark(tmp_path_factory) -> SparkSession:
    folder = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tallyline-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(folder / "warehouse"))
        .config("spark.checkpoint.dir", str(folder / "checkpoint"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sales_csv(tmp_path_factory) -> str:
    path = tmp_path_factory.mktemp("sales") / "sales.csv"
    path.write_text(SALES)
    return str(path)


@pytest.fixture(scope="session")
def sales(spark, sales_csv) -> DataFrame:
    return spark.read.csv(sales_csv, header=True, inferSchema=True)


def load(spark: SparkSession, name: str) -> DataFrame:
    return spark.read.parquet(f"{SF_DIR}/{name}.parquet")

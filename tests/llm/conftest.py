from __future__ import annotations

import pytest
from pyspark.sql import SparkSession

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def tables(spark: SparkSession):
    return lambda name: spark.read.parquet(f"{SF}/{name}.parquet")

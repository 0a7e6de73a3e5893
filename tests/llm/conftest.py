import pytest
from frames import edge_rows, frame


@pytest.fixture(scope="session")
def edge(spark):
    return frame(spark, edge_rows()).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return frame(spark, []).cache()


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")

"""Parquet tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one table; any path that Spark can read will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a task whose work costs far more than they weigh.
TASK_ROWS = 25_000


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt evenly to tasks, before work that costs far more than they weigh: one a core at least, and of at most ``TASK_ROWS`` however large the row groups of the input are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, -(-df.count() // TASK_ROWS)))

"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share, from spark.checkpoint.dir; a temporary one only where that is unset in local mode, as in tests."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="docfacts-"))
    return sc.getCheckpointDir()


#: Rows of a batch that goes to Python, unless the session says otherwise: long texts make large batches.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker and its Arrow buffers hold. The setting stays with the session; one of the session's own is kept."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(BATCH_ROWS))


_made: list[tuple[SparkSession, str]] = []


#: Characters of a plan that the driver keeps for each of the operators' own jobs.
PLAN_CHARS = 1 << 14


@contextmanager
def short_plans(spark: SparkSession) -> Iterator[None]:
    """Jobs in here leave only the beginning of their plan with the driver, which keeps those of a thousand jobs; a lattice's has half a million characters."""
    name = "spark.sql.maxPlanStringLength"
    own = spark.conf.get(name, None)
    spark.conf.set(name, str(min(PLAN_CHARS, int(own or PLAN_CHARS))))
    try:
        yield
    finally:
        spark.conf.unset(name) if own is None else spark.conf.set(name, own)


#: Seconds that pass, at least, from one collection of the driver's garbage to the next.
COLLECT_SECONDS = 3

_collected = [0.0]


def _collect(spark: SparkSession) -> None:
    """Collect the driver's garbage, now and then.

    Spark deletes the shuffle files and broadcasts of a finished plan only when the
    driver collects the plan itself. Many small jobs in a row also leave task records
    behind, over which the driver's heap would otherwise grow to its limit.
    """
    if time.monotonic() - _collected[0] >= COLLECT_SECONDS:
        spark.sparkContext._jvm.System.gc()
        _collected[0] = time.monotonic()


#: For a table in a local folder Hadoop writes a second file with checksums beside each, and the JVM starts a process to set the mode of either.
NO_CRC_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def narrowed(df: DataFrame) -> DataFrame:
    """Rows of a few numbers behind a shuffle, in a quarter of its partitions: each task that writes starts processes, which count with the JVM's memory until they have become another program."""
    return df.coalesce(max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 4))


def saved(df: DataFrame, narrow: bool = False) -> DataFrame:
    """The same rows from a Parquet table in the shared folder: computed once, lineage cut, safe against lost executors.

    A table, not checkpoint(), so that the plan read back is a plain scan: loops
    then plan each round afresh, with nothing carried along from the rounds before.
    A ``narrow`` table, of a few numbers a row behind a shuffle, is written by a
    quarter of the shuffle's partitions; in a local folder none has checksum files.
    The tables go with ``discard``, or when the driver's Python ends.
    """
    spark = df.sparkSession
    if not _made:
        atexit.register(_clear)
    path = f"{shared_dir(spark)}/saved-{uuid.uuid4().hex}"
    _made.append((spark, path))
    if narrow:
        df = narrowed(df)
    with short_plans(spark):
        df.write.options(**NO_CRC_FILES).option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    _collect(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``saved`` made and that nothing reads any more."""
    for table in tables:
        _delete(table.sparkSession, table._saved_at)
        _made.remove((table.sparkSession, table._saved_at))


def _delete(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    if sc._jsc is not None:
        at = sc._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def _clear() -> None:
    for spark, path in _made:
        _delete(spark, path)
    _made.clear()


#: Bytes of input that a task has at least, where each task first loads a large table.
TASK_BYTES = 32 << 20


def few_tasks(df: DataFrame, of: DataFrame) -> DataFrame:
    """``df`` in as many tasks as the estimated size of ``of`` calls for, at least one a core; never in more than it has."""
    size = int(of._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.coalesce(min(max(df.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES)), (1 << 31) - 1))


def remainder(doc_id, divisor: int):
    """crc32 of the id as text, modulo the divisor; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % divisor

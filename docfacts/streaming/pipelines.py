"""Streams: landed documents into staging, and duplicates within a time to live."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


#: Parts of a staging store, by the hash of its key.
PARTS = 256


def stage_batches(stream: DataFrame, build: Callable[[DataFrame], DataFrame], store: str, key: str, checkpoint: str, once: bool = True):
    """Append each micro-batch's new documents to ``store``; a batch that runs again adds nothing twice.

    Rows whose key the store has, in whatever batch, are skipped before ``build`` runs
    on them; of the store only the keys of those parts are read that the batch's keys
    are of. A batch writes a folder of its own, so a repeated batch overwrites itself.
    """
    part = F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int")

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        first = batch.dropDuplicates([key])
        wanted = [r["part"] for r in first.select(part.alias("part")).distinct().collect()]  # PARTS at most
        try:
            held = spark.read.option("basePath", store).parquet(store)
            seen = held.filter((F.col("batch") != number) & F.col("part").isin(wanted)).select(key)
            first = first.join(seen, key, "left_anti")
        except Exception as e:  # the store is not there yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        build(first).withColumn("part", part).repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{store}/batch={number}")

    writer = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="60 seconds")).start()


def mark_repeats(stream: DataFrame, key: str, ts: str, hours: int) -> DataFrame:
    """(key, ts, is_repeat) of a stream: seen within ``hours`` before; every sighting starts the time anew.

    State is one time per key and goes once the watermark has passed its time to
    live. Within a micro-batch a key's sightings are taken in the order of time.
    """
    life = hours * 3_600_000

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values("ts")
        last = state.get[0] if state.exists else None
        out = []
        for t in rows["ts"]:
            now = int(t.timestamp() * 1000)
            out.append(last is not None and now - last <= life)
            last = now
        state.update((last,))
        state.setTimeoutTimestamp(max(last + life, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": [k[0]] * len(rows), "ts": rows["ts"].to_numpy(), "is_repeat": out})

    rows = stream.select(F.col(key).cast("string").alias("key"), F.col(ts).cast("timestamp").alias("ts")).withWatermark("ts", f"{hours} hours")
    return rows.groupBy("key").applyInPandasWithState(run, "key string, ts timestamp, is_repeat boolean", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def replayed(spark: SparkSession, folder: str, schema) -> DataFrame:
    """A folder of Parquet files as a stream, a file at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)

"""Sharding by jump consistent hashing (Lamping and Veach, 2014).

A key's shard follows from the key and the number of shards alone; no ring
table is kept. One more shard takes about 1/(n+1) of the keys, all of them
into itself.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the published algorithm: its linear congruential step.
_MULTIPLIER = np.uint64(2862933555777941757)


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shards of unsigned 64-bit keys; all keys jump together until each has passed the last shard."""
    if shards < 1:
        raise ValueError("there must be at least one shard")
    state = keys.astype(np.uint64, copy=True)
    shard = np.zeros(len(state), np.int64)
    at, nxt = np.arange(len(state)), np.zeros(len(state), np.int64)
    while len(at):
        shard[at] = nxt
        state = state * _MULTIPLIER + np.uint64(1)
        span = float(1 << 31) / ((state >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
        nxt = ((nxt + 1) * span).astype(np.int64)
        on = nxt < shards
        at, state, nxt = at[on], state[on], nxt[on]
    return shard


def jump_shard(key: Column, shards: int) -> Column:
    """Shard of a 64-bit hash column (for other keys: ``F.xxhash64(key)``)."""

    @F.pandas_udf("int")
    def put(k: pd.Series) -> pd.Series:
        return pd.Series(jump(k.to_numpy(np.int64).view(np.uint64), shards).astype(np.int32))

    return put(key)


def assign(df: DataFrame, key: str, shards: int, keep: dict[str, Column] | None = None, blocks: int = 4096) -> DataFrame:
    """Columns ``key``, those of ``keep``, ``shard``, ``grown_shard`` (with one shard more) and ``slot``.

    Slots number the rows of each shard without gaps from 0. So that no task
    has to order a whole shard, rows are dealt into ``blocks`` by their content;
    a block's first slot comes from the counts of the blocks before it (at most
    shards x blocks counts), and each block of a shard numbers its own rows.

    Defined cases: a null key is a key like any other (the hash of null); rows
    with equal keys share a shard, each with a slot of its own; an empty table
    gives no rows; other columns of the table are ignored, whatever their names.
    """
    kept = {"_key": F.col(key)} | (keep or {})
    cols = df.select(*[c.alias(n) for n, c in kept.items()], F.xxhash64(F.col(key)).alias("_h"))
    rows = cols.select(
        "*",
        jump_shard(F.col("_h"), shards).alias("shard"),
        jump_shard(F.col("_h"), shards + 1).alias("grown_shard"),
        F.pmod(F.xxhash64(*kept), F.lit(blocks)).cast("int").alias("_block"),
    )
    before = Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    first = (
        rows.groupBy("shard", "_block").agg(F.count("*").alias("_n")).select("shard", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    )
    within = Window.partitionBy("shard", "_block").orderBy("_h", *kept)
    return (
        rows.withColumn("_rank", F.row_number().over(within))
        .join(first, ["shard", "_block"])
        .select(F.col("_key").alias(key), *(keep or {}), "shard", "grown_shard", (F.col("_first") + F.col("_rank") - 1).cast("long").alias("slot"))
    )


def op1(spark, sf_dir: str, shards: int = 8) -> DataFrame:
    """All documents in shards by the law ``key``."""
    from docfacts.llm.common import read

    text = F.coalesce(F.col("text"), F.lit(""))
    facts = {"size": (F.octet_length(text) + 1).cast("long"), "text_crc32": F.crc32(text.cast("binary"))}
    return assign(read(spark, sf_dir, "documents"), "doc_id", shards, facts).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )

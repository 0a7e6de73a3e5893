"""Connected components of an edge table, by rounds of hooking and pointer jumping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docfacts.llm.common import saved

#: Edges (two longs each) that one task finishes, instead of further rounds.
FEW_EDGES = 1 << 14


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hi, to) of all nodes of at most FEW_EDGES edges (hi, lo)."""
    edges = [np.stack([b.column(i).to_numpy() for i in (0, 1)]) for b in batches]
    if not edges:
        return
    ids, at = np.unique(np.concatenate(edges, axis=1), return_inverse=True)
    x, y = at.reshape(2, -1)
    label = np.arange(len(ids))
    while not np.array_equal(label[x], label[y]):
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        while not np.array_equal(label[label], label):
            label = label[label]
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[label])], ["hi", "to"])


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable, for each id in ``edges`` (a, b).

    In each round every node with a smaller neighbour hooks onto its smallest
    neighbour, the hooks are followed to their ends, and the edges between
    different ends are what the next round sees. Only nodes smaller than all of
    their neighbours live on, so the edges vanish in a few rounds; a hot node is
    one group of a partial aggregate, never a list. What is left is finished by
    one task once it is at most FEW_EDGES edges.

    Defined cases: an edge with a null end is no edge; one from a node to itself
    counts for nothing, and its node has no row unless another edge has it; repeated
    edges are one; no edges give no rows.
    """
    def between(a, b):
        return F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")

    left = saved(edges.filter("a is not null and b is not null").select(*between(F.col("a"), F.col("b"))).filter("hi <> lo").distinct(), narrow=True)
    labels = None

    def passed(hooks: DataFrame) -> DataFrame:
        if labels is None:
            return every.join(hooks, every["id"] == hooks["hi"], "left").select("id", F.coalesce("to", "id").alias("component"))
        return labels.join(hooks, labels["component"] == hooks["hi"], "left").select("id", F.coalesce("to", "component").alias("component"))

    every = left.select(F.explode(F.array("hi", "lo")).alias("id")).distinct()
    while (size := left.count()) > FEW_EDGES:
        hooks = saved(left.groupBy("hi").agg(F.min("lo").alias("to")), narrow=True)
        while True:
            on = hooks.select(F.col("hi").alias("_at"), F.col("to").alias("_on"))
            jumped = saved(hooks.join(on, hooks["to"] == on["_at"], "left").select("hi", F.coalesce("_on", "to").alias("to"), F.col("_on").isNotNull().alias("moved")), narrow=True)
            hooks = jumped.select("hi", "to")
            if jumped.filter("moved").isEmpty():
                break
        labels = saved(passed(hooks), narrow=True)
        low = hooks.select(F.col("hi").alias("_l"), F.col("to").alias("_lt"))
        high = hooks.select(F.col("hi").alias("_h"), F.col("to").alias("_ht"))
        moved = left.join(high, left["hi"] == high["_h"], "left").join(low, left["lo"] == low["_l"], "left")
        left = saved(moved.select(*between(F.coalesce("_ht", "hi"), F.coalesce("_lt", "lo"))).filter("hi <> lo").distinct(), narrow=True)
    if not size and labels is not None:
        return labels
    last = left.coalesce(1).mapInArrow(_finish, "hi long, to long")
    return last.select(F.col("hi").alias("id"), F.col("to").alias("component")) if labels is None else passed(last)

"""Exact top-k search by MaxScore (Turtle and Flood, 1995).

A vector is a document, its components are terms. A query's term has one sign;
components of that sign form the term's posting list and add to the score, the
others take from it. Candidates are dealt into shards of bounded size, queries
into blocks; a task holds one shard and one block, orders the shard's postings
by term, and for each query

* bounds each term's gain by the largest component in its posting list,
* splits the terms at the running threshold: those whose bounds together stay
  below it are non-essential, for a candidate that only they favour cannot win,
* walks the essential postings into partial sums, in order of falling bounds,
* probes the other terms for candidates whose partial sum plus remaining bounds
  still reaches the threshold,
* raises the threshold with the k-th best exact score of the candidates that lead
  so far, whenever a few more terms are done.

The first shard goes ahead of the others: its k-th best score of a query is where
the query's threshold begins in all of them. Each task gives k rows per query at most; these are merged by a window over k
rows a shard, not over the candidates. Scores are integers, so results are exact.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docfacts.llm.common import saved

#: Vectors in a shard and queries in a block, on average.
SHARD_ROWS, BLOCK_ROWS = 8192, 1024
#: Terms that are probed between two attempts to raise the threshold.
RAISE_TERMS = 12


def quantised(embedding: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of each component as double; null for a vector that is null or holds a null or non-finite component."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~F.coalesce(bad, F.lit(True)), F.transform(embedding, lambda x: F.floor(x.cast("double") * scale).cast("long")))


class Shard:
    """Postings of some vectors: per term, candidates with positive and with negative components."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.lexsort((ids,))
        self.ids, self.vectors = ids[order], np.ascontiguousarray(vectors[order].T)
        self.up = [np.flatnonzero(c > 0) for c in self.vectors]
        self.down = [np.flatnonzero(c < 0) for c in self.vectors]
        self.most = self.vectors.max(axis=1, initial=0)
        self.least = self.vectors.min(axis=1, initial=0)

    def search(self, own: int, query: np.ndarray, k: int, threshold: float = -math.inf) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best candidates of at least ``threshold``, best first, ties to smaller ids; ``own`` is left out."""
        terms = np.flatnonzero(query)
        bound = np.where(query[terms] > 0, query[terms] * self.most[terms], query[terms] * self.least[terms])
        falling = np.argsort(-bound, kind="stable")
        terms, bound = terms[falling], bound[falling]
        rest = np.concatenate((np.cumsum(bound[::-1])[::-1], [0]))  # what terms from here on can add at most
        open_ = self.ids != own

        def raised(some: np.ndarray) -> float:
            """The threshold after the exact scores of some candidates."""
            if len(some) < k:
                return threshold
            return max(threshold, np.partition(query @ self.vectors[:, some], len(some) - k)[len(some) - k])

        # It begins with the candidates that the strongest posting favours most.
        if len(terms):
            lists = self.up if query[terms[0]] > 0 else self.down
            first = lists[terms[0]]
            first = first[open_[first]]
            gain = query[terms[0]] * self.vectors[terms[0]][first]
            threshold = raised(first[np.argsort(-gain, kind="stable")[: 4 * k]])
        # Terms from ``split`` on are non-essential: alone they stay below the threshold.
        split = int(np.flatnonzero(rest < threshold)[0]) if (rest < threshold).any() else len(terms)
        if threshold <= 0:  # a candidate on no essential posting, with a score of 0 or less, may still win
            live, partial, done = np.flatnonzero(open_), np.zeros(int(open_.sum()), np.int64), 0
        else:
            acc, seen = np.zeros(len(self.ids), np.int64), np.zeros(len(self.ids), bool)
            for t in terms[:split]:
                on = (self.up if query[t] > 0 else self.down)[t]
                acc[on] += query[t] * self.vectors[t][on]
                seen[on] = True
            live = np.flatnonzero(seen & open_)
            partial, done = acc[live], split
            keep = partial + rest[done] >= threshold
            live, partial = live[keep], partial[keep]
        if done:  # what essential terms take away, strongest first, while candidates stay competitive
            for t in terms[:done]:
                v = query[t] * self.vectors[t][live]
                partial = partial + np.minimum(v, 0)
                keep = partial + rest[done] >= threshold
                live, partial = live[keep], partial[keep]
        for i in range(done, len(terms)):
            if (i - done) % RAISE_TERMS == 0 and len(live) > 4 * k:
                threshold = raised(live[np.argpartition(-partial, 4 * k)[: 4 * k]])
            partial = partial + query[terms[i]] * self.vectors[terms[i]][live]
            if len(live) > k:
                keep = partial + rest[i + 1] >= threshold
                live, partial = live[keep], partial[keep]
        best = np.lexsort((self.ids[live], -partial))[:k]
        return self.ids[live][best], partial[best]


def _matrix(lists: pa.ChunkedArray, width: int) -> np.ndarray:
    lens = np.array(lists.combine_chunks().value_lengths(), np.int64)
    flat = lists.combine_chunks().flatten().to_numpy()
    out = np.zeros((len(lens), width), np.int64)
    row = np.repeat(np.arange(len(lens)), lens)
    out[row, np.arange(len(flat)) - np.repeat(np.concatenate(([0], np.cumsum(lens)[:-1])), lens)] = flat
    return out


def top_k(candidates: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``candidates`` and ``queries`` (id, vec: array<long>) to (query_id, rank, vec_id, score).

    Defined cases: rows with a null id or vector take no part; the shorter of two
    vectors counts as padded with zeros; a query's own row, and any row of its
    id, is no candidate; of query rows that repeat an id, the smallest vector asks;
    repeated candidate rows each count; fewer candidates than k give all of them;
    empty tables give no rows.
    """
    able = saved(candidates.filter("id is not null and vec is not null").select("id", "vec"))
    asking = saved(queries.filter("id is not null and vec is not null").groupBy("id").agg(F.min("vec").alias("vec")))
    shards = max(1, math.ceil(able.count() / SHARD_ROWS))
    blocks = max(1, math.ceil(asking.count() / BLOCK_ROWS))
    left = able.select("id", "vec", F.pmod(F.xxhash64("id", "vec"), F.lit(shards)).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block")

    def run(docs: pa.Table, asks: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int]] = []
        if len(docs) and len(asks):
            width = max(max(t["vec"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False).max() for t in (docs, asks)), 1)
            shard = Shard(docs["id"].to_numpy(), _matrix(docs["vec"], width))
            for own, q, least in zip(asks["id"].to_numpy(), _matrix(asks["vec"], width), asks["least"].to_pylist(), strict=True):
                ids, scores = shard.search(int(own), q, k, -math.inf if least is None else least)
                out += [(int(own), int(i), int(s)) for i, s in zip(ids, scores, strict=True)]
        return pa.table([pa.array([o[j] for o in out], pa.int64()) for j in range(3)], ["query_id", "vec_id", "score"])

    def searched(at: int, upto: int, asks: DataFrame) -> DataFrame:
        """The best of each of some shards."""
        right = asks.select("id", "vec", "least", F.explode(F.sequence(F.lit(at), F.lit(upto - 1))).alias("shard"), block)
        some = left.filter((F.col("shard") >= at) & (F.col("shard") < upto))
        return some.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(run, "query_id long, vec_id long, score long")

    found = searched(0, 1, asking.withColumn("least", F.lit(None).cast("long")))
    if shards > 1:
        found = saved(found)
        least = found.groupBy(F.col("query_id").alias("id")).agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
        found = found.unionByName(searched(1, shards, asking.join(least, "id", "left")))
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2(spark, sf_dir: str) -> DataFrame:
    from docfacts.llm.common import read

    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), quantised(F.col("embedding")).alias("vec"))
    return top_k(rows, rows.filter("id % 100 = 0"), 10)


OP2_SQL = """
WITH v AS (SELECT CAST(vec_id AS BIGINT) AS id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS v
           FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS query_id, b.id AS vec_id,
             CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) AS BIGINT) AS score
      FROM v a JOIN v b ON a.id <> b.id WHERE a.id % 100 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""

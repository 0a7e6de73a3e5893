import math
import random

from pyspark.sql import functions as F

from docfacts.llm import maxscore


def brute(rows, k):
    vec = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, a in {i: min(v for j, v in vec if j == i) for i, _ in vec if i % 100 == 0}.items():
        found = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in vec if i != q)[:k]
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(found)}
    return out


def search(spark, rows, k=10):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    vecs = df.select(F.col("vec_id").alias("id"), maxscore.quantised(F.col("embedding")).alias("vec"), F.lit(1).alias("shard"), F.lit(1).alias("block"))
    return {tuple(r) for r in maxscore.top_k(vecs, vecs.filter("id % 100 = 0"), k).collect()}


def test_against_brute_force(spark, sf, monkeypatch):
    monkeypatch.setattr(maxscore, "SHARD_ROWS", 64)
    monkeypatch.setattr(maxscore, "BLOCK_ROWS", 2)
    rng = random.Random(1)
    rows = [(i, [float(int(rng.gauss(0, 1) * 8) / 8) if rng.random() < 0.4 else 0.0 for _ in range(12)]) for i in range(500)]
    assert search(spark, rows) == brute(rows, 10)


def test_edges(spark):
    good = [1.0, -0.5]
    rows = [(0, good), (1, None), (2, [float("nan"), 1.0]), (3, [float("inf"), 1.0]), (4, [None, 1.0]), (None, good), (5, good), (6, good), (7, [0.0, 0.0]), (8, [-1.0, 0.5]), (100, [0.0, 0.0])]
    assert search(spark, rows) == brute(rows, 10)
    assert search(spark, []) == set()
    assert search(spark, [(0, good)]) == set()

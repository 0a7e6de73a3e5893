import os

import numpy as np
from pyspark.sql import functions as F

from docfacts.llm import quality
from docfacts.llm.wordhash import pieces


def test_compiled_rules_equal_the_fitted_ones(spark, sf, documents):
    known = spark.read.parquet(f"{sf}/labels.parquet").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    model = quality.fit(documents.select(F.col("doc_id").alias("id"), "text"), known)
    assert model.rules
    stats = {r["doc_id"]: np.array(tuple(r["s"])) for r in documents.select("doc_id", quality.statistics("text").alias("s")).collect()}
    for r in quality.score(documents, model).collect():
        x = stats[r["doc_id"]][None, :]
        total = model.intercept + sum(w for rule, w in zip(model.rules, model.weights) if quality._fires(rule, x)[0])
        assert abs(r["score"] - 1 / (1 + np.exp(-total))) < 1e-9


def test_query_on_held_out_labels(spark, sf):
    sf = os.path.join(os.path.dirname(sf), "sf0.01")  # the smallest table with labels enough
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in quality.op8(spark, sf).collect()]
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in held) >= 0.9 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)


def test_statistics_of_a_text():
    import pyarrow as pa

    (_, _, words), = pieces(pa.array(["Ab cd cd\nAb cd cd\n12 $%", ""]), lower=False)
    got = dict(zip(quality.STATS, quality.measure(words)[0]))
    assert got["log_words"] == np.log1p(8) and got["mean_word"] == 2 and got["distinct_words"] == 4 / 8 and got["top_word"] == 0.5 and got["repeated_lines"] == 1 / 3
    assert not quality.measure(words)[1].any()


def test_edges(spark, edge, nothing):
    labels = spark.createDataFrame([(1, 1), (1, 0), (5, None), (6, 7), (None, 1)], "id long, label int")
    model = quality.fit(edge.select(F.col("doc_id").alias("id"), "text"), labels)
    assert len({r["score"] for r in quality.score(edge, model).collect()}) == 1
    assert quality.score(nothing, model).count() == 0
    none = quality.fit(nothing.select(F.col("doc_id").alias("id"), "text"), labels)
    assert none.intercept == 0

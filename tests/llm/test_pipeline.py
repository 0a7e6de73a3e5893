import re
from collections import Counter

import corpus_pipeline
from frames import CLASH
from pyspark.sql import functions as F

from docfacts.llm import mixing
from brute_stages import brute_near, brute_passages


def test_stages_against_brute_force(spark, sf, documents, tmp_path):
    docs, kept = documents, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, sf)
        if name != "sentencepiece":
            assert docs.columns == documents.columns
        path = str(tmp_path / name)
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        kept[name] = docs
        rows = before.collect()
        if name == "language":
            lettered = {r["doc_id"] for r in rows if re.search(r"[^\W\d_]", r["text"] or "")}
            assert {r["doc_id"] for r in docs.collect()} == lettered  # clean documents stay
        elif name == "near_duplicates":
            found = brute_near([(r["doc_id"], r["text"]) for r in rows], 5, 80)
            assert {r["doc_id"] for r in docs.collect()} == {i for i, _, c in found if i == c}
        elif name == "substrings":
            want = brute_passages([(r["doc_id"], r["text"]) for r in rows], corpus_pipeline.WINDOW)
            assert {r["doc_id"]: r["text"] for r in docs.collect()} == want
            assert docs.filter(F.length("text") != F.col("n_chars")).count() == 0
        elif name == "mixing":
            plan = {r["doc_id"]: r["copies"] for r in mixing.schedule(before).collect()}
            assert Counter(r["doc_id"] for r in docs.collect()) == Counter({i: n for i, n in plan.items() if n})
            order = [r["doc_id"] for r in mixing.positions(mixing.schedule(before)).orderBy("position").collect()]
        else:
            assert [r["doc_id"] for r in docs.orderBy("place").collect()] == order  # the training order is in the result


def test_run_is_the_stages(spark, sf):
    assert corpus_pipeline.ORACLE_SQL is None and 4 <= len(corpus_pipeline.STAGES) <= 5
    assert corpus_pipeline.run(spark, sf).filter("n_pieces > 0 and place is not null").count() > 0


def test_edges(spark, edge, nothing):
    docs = edge.drop(*CLASH)
    for table in (edge, nothing, docs, nothing.drop(*CLASH)):  # with and without columns that clash with those used inside
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, "")
            assert name == "sentencepiece" or out.columns == table.columns
            out.collect()
    copies = corpus_pipeline.drop_copies(spark, edge, "").collect()
    assert sorted(str(r["doc_id"]) for r in copies) == sorted(["1", "2", "3", "4", "5", "6", "None", "9", "11", "12"])

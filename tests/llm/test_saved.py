"""Files of tables between steps: for each, the JVM starts processes."""

import os

import corpus_pipeline
import pytest
from frames import NEAR, frame

from docfacts.llm import minhash
from docfacts.llm.common import discard, saved


@pytest.fixture
def many_partitions(spark):
    """As many tasks as a shuffle has partitions, and a small table in many files."""
    own = {"spark.sql.shuffle.partitions": "80", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.maxPartitionBytes": "1k", "spark.sql.files.openCostInBytes": "1k"}
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def files(table) -> list[str]:
    return os.listdir(table._saved_at.removeprefix("file:"))


def test_no_checksum_files(spark):
    table = saved(spark.range(100).repartition(3))
    assert len(files(table)) == 3 and all(f.startswith("part-") for f in files(table))
    assert sorted(r["id"] for r in table.collect()) == list(range(100))
    discard(table)


@pytest.fixture
def in_many_files(spark, tmp_path, many_partitions):
    path = str(tmp_path / "documents")
    rows = [(i, NEAR + (f" tail{i}" if i % 3 else ""), "en", "a", None) for i in range(40)] + [(100 + i, " ".join(f"w{i}x{j}" for j in range(60)), "en", "a", None) for i in range(20)]
    frame(spark, rows, clash=False).repartition(40).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture
def made(monkeypatch):
    """The tables that near_duplicates saves itself."""
    tables = []
    monkeypatch.setattr(minhash, "saved", lambda *a, **b: tables.append(saved(*a, **b)) or tables[-1])
    monkeypatch.setattr(minhash, "discard", lambda *a: None)
    return tables


def test_copies_go_in_tasks_by_size(spark, in_many_files, made):
    assert in_many_files.rdd.getNumPartitions() >= 40
    kept = corpus_pipeline.drop_copies(spark, in_many_files, "")
    assert kept.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    assert len(files(made[0])) <= spark.sparkContext.defaultParallelism  # signatures, straight from the documents
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, *range(100, 120)]


def test_near_duplicates_in_a_quarter_of_the_partitions(in_many_files, made):
    found = minhash.near_duplicates(in_many_files)
    assert found.rdd.getNumPartitions() <= 20 and max(len(files(t)) for t in made) <= 20
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == {i: 0 if i < 100 else i for i in [*range(40), *range(100, 120)]}

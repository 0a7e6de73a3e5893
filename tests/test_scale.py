"""Work that must not grow faster than its input."""

import random
import time

import pytest
from pyspark.sql import functions as F

from docfacts.functions import advanced, extract
from docfacts.operators import dedupe
from docfacts.sources.tables import TASK_ROWS, spread


def seconds(df):
    began = time.time()
    df.write.format("noop").mode("overwrite").save()
    return time.time() - began


def test_lines_of_a_record_are_folded_once(spark):
    body = "\n".join(["ACME SRL", *["IVA 21%: 300,00", "Subtotal: 1,00"] * 3000, "Importe Total: $ 5,00"])
    docs = spark.createDataFrame([(body,)], "c string")
    assert advanced.record(F.col("c")) is not None and docs.select(advanced.vat_sum(F.col("c")).alias("v")).first()["v"] == 300 * 3000
    assert seconds(docs.select(advanced.vat_sum(F.col("c")))) < 3


def test_many_numbers_of_a_text_are_found_in_one_pass(spark):
    body = "nada\n" * 50 + "\n".join(f"Factura N 0001-{i:08d}" for i in range(3000))
    docs = spark.createDataFrame([(body,)], "c string")
    n = extract.number(F.col("c")).alias("n")
    assert tuple(docs.select(n).first()["n"]) == ("0001", "00000000")
    assert seconds(docs.select(n)) < 6


def test_costly_work_has_tasks_of_few_rows(spark):
    uneven = spark.range(60_000).repartition(16, F.lit(1))
    dealt = spread(uneven)
    sizes = [r["n"] for r in dealt.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 60_000 and max(sizes) <= TASK_ROWS and len(sizes) >= spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("shared", [None, 1, 2, 3])
@pytest.mark.parametrize("radius", [0, 3, 12])
def test_hash_pairs_are_those_of_brute_force(spark, shared, radius):
    pick = random.Random(5)
    rows = [(i, pick.getrandbits(32), pick.getrandbits(32)) for i in range(40)]
    for i in range(40, 120):
        _, *hashes = pick.choice(rows)
        rows.append((i, *[h ^ sum(1 << k for k in pick.sample(range(32), pick.randrange(8))) for h in hashes]))
    want = {(i, j, d) for i, x, y in rows for j, u, v in rows if i < j and (d := (x ^ u).bit_count() + (y ^ v).bit_count()) <= radius}
    got = [tuple(r) for r in dedupe.hash_pairs(spark.createDataFrame(rows, "id long, x long, y long"), "id", [F.col("x"), F.col("y")], 32, radius, shared).collect()]
    assert len(got) == len(want) and set(got) == want


def test_hashes_within_more_bits_than_parts_and_in_whole_longs(spark):
    rows = spark.createDataFrame([(1, 0), (2, -1), (3, 1)], "id long, x long")
    assert {tuple(r) for r in dedupe.hash_pairs(rows, "id", F.col("x"), 64, 70).collect()} == {(1, 2, 64), (1, 3, 1), (2, 3, 63)}
    assert {tuple(r) for r in dedupe.hash_pairs(rows, "id", F.col("x"), 64, 0).collect()} == set()


def test_hashes_that_meet_by_chance_are_few(spark):
    """Of 60,000 hashes 1.8 billion pairs are possible; one common part of thirteen would let over a hundred million meet."""
    hashes = spark.range(60_000).select("id", *[F.xxhash64("id", F.lit(k)).bitwiseAND(F.lit((1 << 32) - 1)).alias(f"h{k}") for k in range(2)])
    pairs = dedupe.hash_pairs(hashes, "id", [F.col("h0"), F.col("h1")], 32, 6)
    assert seconds(pairs) < 25

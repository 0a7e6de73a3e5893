"""From raw documents to training tokens, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept.
Rows without a text, or without a letter in it, go in the first stage; a null id,
language or source is a value like any other; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docfacts.llm import language, minhash, mixing, sentencepiece, substrings
from docfacts.llm.common import few_tasks, read, remainder, saved

#: A document goes if no language is this likely.
LEAST_SCORE = 0.5
#: Words of a passage that is cut out where it repeats.
WINDOW = 35


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that have a language; learned from the given languages of three quarters of them."""
    train = docs.filter(remainder(F.col("doc_id"), 4) != 2).select(F.col("doc_id").alias("id"), "text", "lang")
    found = docs.select("*", language.predicted(docs, language.fit(train)).alias("_found"))
    return found.filter((F.col("_found.lang") != "und") & (F.col("_found.score") >= LEAST_SCORE)).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates, the one with the smallest id (a null id last), and of equal rows one.

    Rows are told apart by a key made of id and text, so that of rows that repeat an id, or have none, each is decided for itself.
    """
    row = F.shiftrightunsigned(F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text"), 1)
    keyed = docs.withColumn("_row", row)
    found = saved(minhash.near_duplicates(keyed.select("_row", "text"), key="_row", shingle=5, percent=80))

    def without(rows: DataFrame, keys: DataFrame) -> DataFrame:
        keys = saved(keys, narrow=True)
        return rows.join(F.broadcast(keys) if keys.count() <= minhash.BROADCAST_ROWS else keys, "_row", "left_anti")

    linked = found.filter("_row <> component_id")
    members = linked.select("_row", "component_id").union(linked.select(F.col("component_id").alias("_row"), "component_id")).distinct()
    ranked = members.join(keyed.select("_row", "doc_id"), "_row").select("component_id", F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_row").alias("rank"))
    first = ranked.groupBy("component_id").agg(F.min("rank")["_row"].alias("_first"))
    kept = without(keyed, members.join(first, "component_id").filter("_row <> _first").select("_row"))
    twice = saved(found.groupBy("_row").agg(F.count("*").alias("n")).filter("n > 1").select("_row"), narrow=True)
    if twice.isEmpty():
        return few_tasks(kept.select(*docs.columns), docs)
    again = kept.join(twice, "_row", "left_semi").dropDuplicates(["doc_id", "text"])
    return few_tasks(without(kept, twice).unionByName(again).select(*docs.columns), docs)


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut out passages that occur more than once."""
    return substrings.cleaned(docs, window=WINDOW).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix reads, as often as it reads them, in training order."""
    return mixing.mixed(docs)


def place(docs: DataFrame) -> Column:
    """A number that ascends in the order in which rows were written, for documents read from Parquet files of one table; null for others.

    It is made of the file's number, the number of a part of it, and the row's number therein.
    """
    try:
        docs.select("_metadata.file_name", "_metadata.row_index")
    except AnalysisException:  # not read from such files
        return F.lit(None).cast("long")
    name = F.col("_metadata.file_name")
    part, piece = (F.coalesce(F.regexp_extract(name, pattern, 1).try_cast("long"), F.lit(0)) for pattern in (r"^part-(\d+)", r"-c(\d+)[^-]*$"))
    return F.shiftleft(part, 43) + F.shiftleft(piece, 32) + F.col("_metadata.row_index")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, place, n_pieces, ids) of each document; sorted by place, they are in training order."""
    return sentencepiece.encode(docs, carry={"place": place(docs)}).select("doc_id", "place", F.size("ids").cast("long").alias("n_pieces"), "ids")


STAGES = [
    ("language", identify),
    ("near_duplicates", drop_copies),
    ("substrings", cut_passages),
    ("mixing", mix),
    ("sentencepiece", encode),
]

#: SQL has no means for language models, signatures or lattices; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

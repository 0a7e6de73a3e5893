"""Small tables of hard cases."""

CLASH = ["id", "th", "h", "n", "key", "unit", "shard", "size", "row", "comp", "rep", "band", "sig", "own", "words", "kept", "bucket", "_key", "_id", "vec"]


def frame(spark, rows, clash=True):
    """Documents with columns whose names clash with those that operators use inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.lit("x").alias(c) for c in CLASH]) if clash else df


WORDS = "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their".split()
LONG = " ".join(WORDS[i % 37] + str(i % 11) for i in range(6000))
NEAR = " ".join(WORDS[i * 7 % 37] + str(i % 13) for i in range(200))


def edge_rows():
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, near copies."""
    return [
        (1, "The quick brown fox, jumps over the lazy dog.\nAgain: the lazy dog!", "en", "a", 60),
        (2, None, "en", "a", None),
        (3, "", "fr", None, 0),
        (4, " \t\n ", None, "b", 4),
        (5, LONG, "en", "a", len(LONG)),
        (6, NEAR, "fr", "b", len(NEAR)),
        (7, NEAR + " tail", "fr", "b", len(NEAR) + 5),
        (8, NEAR, "fr", "b", len(NEAR)),
        (8, NEAR, "fr", "b", len(NEAR)),
        (None, "héllo wörld ▁ 日本語 \U0001f600 x", None, None, None),
        (9, "one two three", "en", "c", 13),
        (10, "ONE TWO three", "en", "c", 13),
        (11, "x" * 5000, "en", "c", 5000),
        (12, "12 34 !!", "en", "c", 8),
    ]

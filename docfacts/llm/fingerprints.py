"""Document fingerprints by consistent weighted sampling (Ioffe, 2010).

DataFrame functions only. A text is a bag of words, a word's weight its number of
uses. For sample j, a word x draws r, c from Gamma(2, 1) and b from U(0, 1), all
from hashes of (x, j) alone. With weight s,

    t = floor(ln s / r + b)        ln a = ln c - r (t - b + 1)

and the sample is the (x, t) of the smallest a. Two texts agree in a sample with a
probability of their generalised Jaccard similarity, sum of min / sum of max.

A sample is one long: ln a as a fixed-point number above 32 bits of a hash of
(x, t), so that the smallest is a plain ``min``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docfacts.llm.common import GAP, saved

SAMPLES = 32
#: Text of a range of documents.
RANGE_BYTES = 2 << 20
_LEAST = -(1 << 63)  # stands for a null id, the smallest


def _uniform(bits: Column, n: int) -> Column:
    """In (0, 1), from the lowest n bits."""
    return (bits.bitwiseAND(F.lit((1 << n) - 1)) + 0.5) / float(1 << n)


def draws(x: Column, j: Column) -> tuple[Column, Column, Column]:
    """(r, b, ln c) of word hash x in sample j."""
    one = F.xxhash64(x, j)
    two = F.xxhash64(one)
    r = -F.ln(_uniform(one, 21) * _uniform(F.shiftrightunsigned(one, 21), 21))
    b = _uniform(F.shiftrightunsigned(one, 42), 21)
    c = -F.ln(_uniform(two, 32) * _uniform(F.shiftrightunsigned(two, 32), 32))
    return r, b, F.ln(c)


def sample(x: Column, s: Column, r: Column, b: Column, ln_c: Column) -> Column:
    """The packed sample of a word of weight s; null for weight 0."""
    t = F.floor(F.ln(F.when(s > 0, s)) / r + b)
    ln_a = ln_c - r * (t - b + 1)
    return F.shiftleft(F.floor((ln_a + 128) * float(1 << 22)).cast("long"), 32).bitwiseOR(F.xxhash64(x, t).bitwiseAND(F.lit(0xFFFFFFFF)))


def ranged(df: DataFrame, key: str, text: str) -> DataFrame:
    """(bucket, copy, k, th, text): documents in ranges of ids; each range also has, as a copy, what comes first in the next (after the last, the first)."""
    docs = df.select(F.coalesce(F.col(key).cast("long"), F.lit(_LEAST)).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(256, size // RANGE_BYTES)
    got = docs.agg(F.min("k").alias("low"), F.approx_percentile("k", [i / n for i in range(1, n)], 100 * n).alias("cuts")).first()
    cuts = sorted({got["low"], *(got["cuts"] or [])}) if got["low"] is not None else [0]
    # Each cut is the id of a document. A range is found in two steps of about sqrt(n) comparisons.
    step = max(1, int(len(cuts) ** 0.5))
    fine, coarse = F.array(*map(F.lit, cuts)), F.array(*map(F.lit, cuts[::step]))
    at = (F.size(F.filter(coarse, lambda c: c <= F.col("k"))) - 1) * step
    bucket = at + F.size(F.filter(F.slice(fine, at + 1, step), lambda c: c <= F.col("k"))) - 1
    placed = docs.select(bucket.alias("bucket"), F.col("k").isin(cuts).alias("first"), "k", F.xxhash64("text").alias("th"), "text")
    also = F.when(F.col("first"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    return placed.select("bucket", "k", "th", "text", F.explode(also).alias("copy")).select(
        F.when(F.col("copy"), F.pmod(F.col("bucket") - 1, F.lit(len(cuts)))).otherwise(F.col("bucket")).alias("bucket"), "copy", "k", "th", "text"
    )


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """(id, n_chars, edited_sha256, sig, edited, next): samples of each text, of its edited text, and of the next text.

    The edited text has the last quarter of its code points replaced by as many
    first ones (or all) of the next document by id; after the last comes the first.

    Defined cases: a null text is empty; an empty text, or one of white space alone,
    has samples of its own kind (-1) and agrees with such texts only; a null id
    comes before all others; rows that repeat an id are ordered by their text's hash,
    equal rows one after the other; an empty table gives no rows; other columns are
    ignored, whatever their names.
    """
    order = Window.partitionBy("bucket").orderBy("copy", "k", "th")
    rows = ranged(df, key, text).select(
        "*", F.row_number().over(order).alias("rn"), F.lead("text").over(order).alias("next"), F.lead("copy").over(order).alias("last")
    )
    rows = rows.filter(~F.col("copy"))
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    ranges = rows.select(
        "bucket", "rn", "k", "last", "text", n.cast("long").alias("n_chars"), F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next", F.lit(1), cut)).alias("edit")
    )
    sides = F.array(*[F.struct(F.lit(i).alias("side"), F.split(c, GAP).alias("words")) for i, c in ((0, "text"), (1, "edit"))])
    words = (
        ranges.select("bucket", "rn", F.explode(sides).alias("s"))
        .select("bucket", "rn", "s.side", F.explode("s.words").alias("word"))
        .select("bucket", "rn", F.xxhash64("word").alias("x"), *[((F.col("side") == i) & (F.col("word") != "")).cast("int").alias(f"s{i}") for i in (0, 1)])
    )
    weights = words.groupBy("bucket", "rn", "x").agg(F.sum("s0").alias("s0"), F.sum("s1").alias("s1"))
    each = weights.select("*", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("j"))
    r, b, ln_c = draws(F.col("x"), F.col("j"))
    drawn = each.select("bucket", "rn", "x", "j", "s0", "s1", r.alias("r"), b.alias("b"), ln_c.alias("c"))
    packed = drawn.select("bucket", "rn", "j", *[sample(F.col("x"), F.col(f"s{i}"), F.col("r"), F.col("b"), F.col("c")).alias(f"a{i}") for i in (0, 1)])
    least = packed.groupBy("bucket", "rn", "j").agg(F.min("a0").alias("a0"), F.min("a1").alias("a1"))
    low = [F.coalesce(F.col(f"a{i}").bitwiseAND(F.lit(0xFFFFFFFF)), F.lit(-1)) for i in (0, 1)]
    signed = least.groupBy("bucket", "rn").agg(F.array_sort(F.collect_list(F.struct("j", low[0].alias("a"), low[1].alias("e")))).alias("all"))
    facts = ranges.select("bucket", "rn", "k", "last", "n_chars", F.sha2("edit", 256).alias("edited_sha256"))
    table = saved(facts.join(signed, ["bucket", "rn"]).select(*facts.columns, F.col("all.a").alias("sig"), F.col("all.e").alias("edited")))
    total = table.agg(F.max("bucket")).first()[0]
    on = table.select("*", F.when(F.col("last"), F.pmod(F.col("bucket") + 1, F.lit((total or 0) + 1))).otherwise(F.col("bucket")).alias("nb"), F.when(F.col("last"), 1).otherwise(F.col("rn") + 1).alias("nrn"))
    nxt = table.select(F.col("bucket").alias("nb"), F.col("rn").alias("nrn"), F.col("sig").alias("next"))
    return on.join(nxt, ["nb", "nrn"]).select(F.when(F.col("k") != _LEAST, F.col("k")).alias(key), "n_chars", "edited_sha256", "sig", "edited", "next")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples: an unbiased estimate of generalised Jaccard similarity."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x) / F.size(a)


def as_text(sig: Column) -> Column:
    """Samples as hexadecimal digits, eight each."""
    return F.array_join(F.transform(sig, lambda x: F.lpad(F.hex(x.bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), "")


def op5(spark, sf_dir: str) -> DataFrame:
    from docfacts.llm.common import read

    rows = fingerprints(read(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("sig")).alias("fingerprint"), as_text(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("edited")).alias("near_edited"), likeness(F.col("sig"), F.col("next")).alias("near_next"),
    )

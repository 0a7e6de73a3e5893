"""Finding a party by its code, else by a part of its name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Length of the parts of a name that it is found by.
GRAM = 3


def _grams(c: Column, size: int) -> Column:
    """The distinct runs of ``size`` characters; none of a shorter text."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - size + 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(size))))


def containing(names: DataFrame, parties: DataFrame, columns: list[str]) -> DataFrame:
    """(name, party): for each distinct ``name``, the smallest ``party`` with a name that holds it, letter case aside.

    A name is found by the rarest of its runs of three characters (a shorter one by
    itself), and what that finds is compared whole: equi-joins, and no match is lost.

    Defined cases: a null or empty name finds nothing; null names of parties are not
    searched; parties that repeat a name compete as others do; empty tables give no rows.
    """
    asked = names.select(F.upper("name").alias("q"), "name").filter("q <> ''").distinct()
    own = parties.select("party", F.explode(F.array(*[F.upper(c) for c in columns])).alias("held")).filter("held is not null and party is not null")
    held = own.groupBy("held").agg(F.min("party").alias("party"))
    runs = [F.when(F.length("held") >= n, _grams(F.col("held"), n)).otherwise(F.array().cast("array<string>")) for n in range(1, GRAM + 1)]
    index = held.select("held", "party", F.explode(F.concat(*runs)).alias("gram"))
    common = index.groupBy("gram").agg(F.count("*").alias("n"))
    parts = asked.select("q").distinct().select("q", F.explode(_grams(F.col("q"), GRAM)).alias("gram")).join(common, "gram", "left")
    rarest = parts.groupBy("q").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r")).select("q", F.col("r.gram").alias("gram"))
    met = rarest.join(index, "gram").filter(F.contains("held", F.col("q")))
    return asked.join(met.groupBy("q").agg(F.min("party").alias("party")), "q").select("name", "party")


def two_tier(docs: DataFrame, parties: DataFrame, columns: list[str]) -> DataFrame:
    """``docs`` (.., code, name) with ``party`` and ``how``: the smallest party of the code, else the smallest whose name holds the document's; 'id', 'name' or 'none'."""
    by_code = parties.filter("code is not null").groupBy("code").agg(F.min("party").alias("_a"))
    by_name = containing(docs.select("name"), parties, columns).withColumnRenamed("party", "_b")
    rows = docs.join(by_code, "code", "left").join(by_name, "name", "left")
    how = F.when(F.col("_a").isNotNull(), "id").when(F.col("_b").isNotNull(), "name").otherwise("none")
    return rows.select(*docs.columns, F.coalesce("_a", "_b").alias("party"), how.alias("how"))

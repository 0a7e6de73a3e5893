"""Exact and near duplicates of documents by hash."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ttl_repeats(df: DataFrame, keys: list[str], ts: str, hours: int, order: list[str]) -> DataFrame:
    """Adds ``is_repeat``: seen within the last ``hours``; every sighting starts the time anew, so only the one before counts."""
    before = F.lag(ts).over(Window.partitionBy(*keys).orderBy(ts, *order))
    return df.withColumn("is_repeat", F.coalesce(F.timestamp_diff("SECOND", before, F.col(ts)) <= hours * 3600, F.lit(False)))


def first_seen(df: DataFrame, content: Column, order: list[Column]) -> DataFrame:
    """Adds ``sha256`` and ``is_first``: the first row of each content."""
    hashed = df.withColumn("sha256", F.sha2(content, 256))
    return hashed.withColumn("is_first", F.row_number().over(Window.partitionBy("sha256").orderBy(*order)) == 1)


def unseen(df: DataFrame, key: str, *known: DataFrame) -> DataFrame:
    """Rows whose key is in none of the tables of known keys: the check before any costly step."""
    keys = known[0].select(key)
    for k in known[1:]:
        keys = keys.unionByName(k.select(key))
    return df.join(keys, key, "left_anti")


#: Up to so many hashes one common part is enough for a pair to be looked at, up to so many two, then three.
FEW_HASHES, MANY_HASHES = 3_000, 3_000_000


def hash_pairs(df: DataFrame, key: str, bits: Column | list[Column], width: int, radius: int, shared: int | None = None) -> DataFrame:
    """Pairs (a, b, distance) of hashes at most ``radius`` bits apart; a hash is a long or several, of ``width`` bits each.

    It is cut in ``radius`` parts and ``shared`` more, so that such hashes have as many
    parts in common (pigeonhole) and an equi-join by each choice of that many parts loses
    none. A pair is made by the first parts that it shares, so that no distinct is needed.
    Chance meetings grow with the square of the rows; with more shared parts, which by
    default come with the number of rows, they are so rare that the rows' own copies, one
    for each choice, weigh more.

    Defined cases: a hash with a null part, and a null key, are in no pair; rows that
    repeat a key make pairs with other keys, each for itself; an empty table gives no rows.
    """
    bits = bits if isinstance(bits, list) else [bits]
    names = [f"_h{k}" for k in range(len(bits))]
    hashed = df.select(F.col(key).alias("id"), *[c.alias(n) for n, c in zip(names, bits, strict=True)]).dropna()
    if shared is None:
        n = hashed.count()
        shared = 1 if n <= FEW_HASHES else 2 if n <= MANY_HASHES else 3
    n_parts = radius + shared
    cuts = [width * len(bits) * i // n_parts for i in range(n_parts + 1)]

    def part(value, lo: int, hi: int) -> list[Column]:
        """The bits from lo up to hi, of each long that has some of them."""
        out = [F.lit(0).cast("long")] if lo == hi else []
        for k in range(lo // width, -(-hi // width)):
            first, last = max(lo - k * width, 0), min(hi - k * width, width)
            moved = F.shiftrightunsigned(value(k), first)
            out.append(moved if last - first == 64 else moved.bitwiseAND(F.lit((1 << (last - first)) - 1).cast("long")))
        return out

    choices = list(combinations(range(n_parts), shared))
    parts = F.array(*[F.xxhash64(*part(lambda k: F.col(names[k]), lo, hi)) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)])
    chosen = F.array(*[F.array(*[F.lit(i) for i in choice]) for choice in choices])
    keys = F.transform(chosen, lambda choice, n: F.xxhash64(n, F.transform(choice, lambda i: F.get(F.col("_parts"), i))))
    rows = hashed.select("id", *names, parts.alias("_parts")).select("id", *names, F.posexplode(keys).alias("choice", "key"))
    a, b = rows.alias("a"), rows.alias("b")
    differ = [F.col(f"a.{n}").bitwiseXOR(F.col(f"b.{n}")) for n in names]
    distance = sum((F.bit_count(x) for x in differ[1:]), F.bit_count(differ[0]))
    equal = [reduce(Column.__and__, [x == 0 for x in part(lambda k: differ[k], lo, hi)]) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]
    met = (F.col("a.key") == F.col("b.key")) & (F.col("a.id") < F.col("b.id")) & (F.col("a.choice") == F.col("b.choice")) & (distance <= radius)
    for first in range(0, n_parts, 62):  # up to a choice's last part, just its own are equal
        at = range(first, min(first + 62, n_parts))
        flags = reduce(Column.__add__, [F.when(equal[i], F.lit(1 << (i - first)).cast("long")).otherwise(F.lit(0).cast("long")) for i in at])
        own, upto = (F.get(F.array(*[F.lit(sum(1 << (i - first) for i in at if held(i, choice))).cast("long") for choice in choices]), F.col("a.choice")) for held in (lambda i, choice: i in choice, lambda i, choice: i <= choice[-1]))
        met = met & (flags.bitwiseAND(upto) == own)
    return a.join(b, met).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), distance.alias("distance"))


def ttl_near(df: DataFrame, key: str, bits: list[Column], width: int, radius: int, ts: str, hours: int) -> DataFrame:
    """Adds ``near_of``: the key of the nearest earlier row at most ``hours`` old whose hash is within ``radius``, of several the latest; null without one.

    Earlier is by time, then by key.
    """
    seen = df.select(F.col(key).alias("_k"), F.col(ts).alias("_ts"))
    pairs = hash_pairs(df, key, bits, width, radius)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "distance"))
    old = seen.select(F.col("_k").alias("a"), F.col("_ts").alias("_old"))
    new = seen.select(F.col("_k").alias("b"), F.col("_ts").alias("_new"))
    held = both.join(old, "a").join(new, "b").filter(
        ((F.col("_old") < F.col("_new")) | ((F.col("_old") == F.col("_new")) & (F.col("a") < F.col("b")))) & (F.timestamp_diff("SECOND", F.col("_old"), F.col("_new")) <= hours * 3600)
    )
    best = held.groupBy(F.col("b").alias("_b")).agg(F.max(F.struct((-F.col("distance")).alias("near"), "_old", "a"))["a"].alias("near_of"))
    return df.join(best, F.col(key) == F.col("_b"), "left").drop("_b")

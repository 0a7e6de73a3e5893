"""Mixing sources to target weights along a time-varying curriculum.

DataFrame functions only. Training time runs from 0 to 1. A source of target T
is shown at the rate T * (1 + a * (2t - 1)) at time t; ``a`` (its slant, from
-1 to 1) makes it fade in or out. The integral is the source's cumulative
demand D(t) = T * (t + a * (t^2 - t)), so D(1) = T whatever the slant. Each
source's documents stand on a line in a fixed pseudo-random order, the line
repeated as often as the demand asks; the middle of a copy at depth u is read
at the time t with D(t) = u. Sorting the copies by t gives the training order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Blocks of a source's line: the first digits of the order's hexadecimal hash.
_BLOCK_DIGITS = 3


def words(text: Column) -> Column:
    """Number of words of a text; null has none."""
    from docfacts.llm.common import WORD

    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, limit: float) -> DataFrame:
    """Target of each source: ``share`` of all sizes, by weight, at most ``limit`` times its own size.

    ``sizes`` has a row per source (source, source_size). Sources by code point,
    null last, take the weights in turn. What is above a limit is shared anew by
    weight until none is above: the targets are min(limit * size, level * weight)
    for one level. With sources by limit/weight, the level is that of the first
    prefix of full sources after which the next one is not full.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(order) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    slant = F.element_at(F.array(F.lit(-0.5), F.lit(0.0), F.lit(0.5)), (rank % 3 + 1).cast("int"))
    named = sizes.withColumns({"weight": weight, "slant": slant, "full": limit * F.col("source_size")})
    filling = Window.orderBy(F.col("full") / F.col("weight"), F.col("source").asc_nulls_last())
    upto, everything = filling.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = (share * F.sum("source_size").over(everything) - F.coalesce(F.sum("full").over(upto), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0))
    )
    tried = named.withColumn("level", level).withColumn("fits", F.col("level") <= F.col("full") / F.col("weight"))
    # The first prefix that fits has the level; if none does, every source is full.
    return tried.withColumn("level", F.min(F.when(F.col("fits"), F.struct(F.col("full") / F.col("weight"), "level"))).over(everything)["level"]).select(
        "source", "source_size", "slant", F.least("full", F.coalesce(F.col("level") * F.col("weight"), F.col("full"))).alias("target")
    )


def schedule(
    df: DataFrame,
    key: str = "doc_id",
    source: str = "source",
    size: Column | None = None,
    weights=(5.0, 2.0, 1.0),
    share: float = 1.5,
    limit: float = 2.0,
    carry: bool = False,
) -> DataFrame:
    """A row per document: row, id, source, size, source_size, target, taken, copies, times.

    ``copies`` is how often the mix reads the document (0 to ``limit`` rounded
    up), ``taken`` the words of those copies, ``times`` the moment of each of those
    readings. A copy is read if its middle is within the demand, so a source's taken
    words are within half a document of its target. ``row`` numbers the rows of the
    schedule; with ``carry``, it holds the whole row of ``df`` instead.

    A hot source is no hot task: its line is cut in 4096 blocks by hash, lengths
    are summed per block first, and each block places its own documents.

    Defined cases: a null source is a source, the last; a null or empty text has
    size 0 and is never read; repeated rows are documents of their own; a null id
    hashes like the empty text; an empty table gives no rows; other columns are
    ignored, whatever their names.
    """
    from docfacts.llm.common import saved

    size = words(F.col("text")) if size is None else size
    at = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"))
    narrow = [F.col(key).alias("id"), F.col(source).alias("source"), size.alias("size"), at.alias("_at"), F.substring(at, 1, _BLOCK_DIGITS).alias("_block")]
    facts = saved(df.select(*narrow, F.monotonically_increasing_id().alias("row")))
    # Rows that share id and size stand in the order of their contents, so that reruns agree.
    rows = df.select(*narrow, F.struct(*[F.col(c) for c in df.columns]).alias("row"), F.xxhash64(*[F.col(c) for c in df.columns]).alias("_tie")) if carry else facts.withColumn("_tie", F.col("row"))
    blocks = saved(facts.groupBy("source", "_block").agg(F.sum("size").alias("_sum")))
    goal = targets(blocks.groupBy("source").agg(F.sum("_sum").alias("source_size")), weights, share, limit)
    before = Window.partitionBy("source").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("source", "_block", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    # One key for a null source too, the same in the window and in the join: rows are dealt once.
    cell = {"_named": F.coalesce("source", F.lit("")), "_null": F.col("source").isNull()}
    at = starts.alias("b").join(goal.alias("g"), F.col("b.source").eqNullSafe(F.col("g.source"))).select("b.source", "_block", "_start", "source_size", "slant", "target")
    inside = Window.partitionBy("_named", "_null", "_block").orderBy("_at", "size", "id", "_tie").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumns(cell).withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = placed.join(at.withColumns(cell).drop("source"), ["_named", "_null", "_block"])
    middle = F.col("_start") + F.col("_inside") + F.col("size") / 2.0
    laps = [middle + lap * F.col("source_size") for lap in range(max(1, int(-(-limit // 1))))]

    def moment(u: Column) -> Column:
        """t with t + a (t^2 - t) = u / target; null beyond the demand."""
        x, a = u / F.col("target"), F.col("slant")
        b = 1 - a
        t = F.when(a == 0, x).otherwise((F.sqrt(b * b + 4 * a * x) - b) / F.when(a == 0, F.lit(None)).otherwise(2 * a))
        return F.when((F.col("size") > 0) & (u <= F.col("target")), t)

    times = F.array_compact(F.array(*map(moment, laps)))
    read = joined.select("row", F.col("id").alias(key), "source", "size", "source_size", "target", times.alias("times"))
    copies = F.size("times").cast("long")
    return read.withColumns({"copies": copies, "taken": copies * F.col("size")})


def positions(scheduled: DataFrame, key: str = "doc_id") -> DataFrame:
    """A row per copy that the mix reads (row, id, source, copy, time, position): the training order, from 0, range-sorted by time.

    Copies are dealt in ranges of time and sorted within each; a range's first
    position is the number of copies in the ranges before, so no task sees them all.

    Defined cases: copies of one time stand by id, row and copy; a document that is
    not read has no row; an empty schedule gives no rows.
    """
    from docfacts.llm.common import saved

    spark = scheduled.sparkSession
    order = ["time", key, "row", "copy"]
    copies = scheduled.select("row", key, "source", F.posexplode("times").alias("copy", "time"))
    sorted_ = copies.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    table = saved(sorted_.select("*", F.monotonically_increasing_id().alias("_at")))
    part = F.shiftright("_at", 33).alias("_part")
    counts = table.groupBy(part).agg(F.count("*").alias("_n"))
    upto = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"))
    numbered = table.withColumn("_part", part).join(F.broadcast(starts), "_part")  # as many rows as ranges
    return numbered.select("row", key, "source", "copy", "time", (F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).alias("position"))


def mixed(df: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """The rows that the mix reads, all columns, each as often as it is read, range-sorted into training order.

    Defined cases: those of ``schedule``; rows of one time stand by id and contents.
    """
    rows = schedule(df, key=key, carry=True, **options)
    copies = rows.select("row", key, F.posexplode("times").alias("copy", "time"))
    return copies.orderBy("time", key, F.xxhash64("row"), "copy").select(*[F.col("row")[c].alias(c) for c in df.columns])


def op10(spark, sf_dir: str) -> DataFrame:
    from docfacts.llm.common import read

    from docfacts.llm.common import saved

    planned = saved(schedule(read(spark, sf_dir, "documents")))
    places = positions(planned).groupBy("row").agg(*[F.max(F.when(F.col("copy") == i, F.col("position"))).alias(f"{name}_position") for i, name in enumerate(("first", "second"))])
    times = [F.get("times", F.lit(i)).alias(f"{name}_time") for i, name in enumerate(("first", "second"))]
    return planned.join(places, "row", "left").select("doc_id", "size", "source_size", "target", "taken", *times, "first_position", "second_position")


OP10_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                  md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS at FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rk FROM s),
n AS (SELECT *, CASE rk % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight,
             CASE rk % 3 WHEN 0 THEN -0.5 WHEN 1 THEN 0.0 ELSE 0.5 END::DOUBLE AS slant, 2.0::DOUBLE * source_size AS full_size FROM w),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(full_size) OVER f, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER f, 0)) AS lev FROM n
      WINDOW f AS (ORDER BY full_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
x AS (SELECT arg_min(lev, full_size / weight) AS lev FROM l WHERE lev <= full_size / weight),
t AS (SELECT source, source_size, slant, least(full_size, coalesce((SELECT lev FROM x) * weight, full_size)) AS target FROM n),
p AS (SELECT d.*, t.source_size, t.slant, t.target,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.at, d.size, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + d.size / 2.0 AS mid
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, CASE WHEN size > 0 AND mid <= target THEN 1 ELSE 0 END AS c1, CASE WHEN size > 0 AND mid + source_size <= target THEN 1 ELSE 0 END AS c2 FROM p),
r AS (SELECT doc_id, size, source_size, target, CAST((c1 + c2) * size AS BIGINT) AS taken,
       CASE WHEN c1 = 1 THEN CASE WHEN slant = 0 THEN mid / target ELSE (sqrt((1 - slant) * (1 - slant) + 4 * slant * (mid / target)) - (1 - slant)) / (2 * slant) END END AS first_time,
       CASE WHEN c2 = 1 THEN CASE WHEN slant = 0 THEN (mid + source_size) / target ELSE (sqrt((1 - slant) * (1 - slant) + 4 * slant * ((mid + source_size) / target)) - (1 - slant)) / (2 * slant) END END AS second_time
       FROM c),
o AS (SELECT doc_id, copy, row_number() OVER (ORDER BY time, doc_id, copy) - 1 AS position
      FROM (SELECT doc_id, 0 AS copy, first_time AS time FROM r UNION ALL SELECT doc_id, 1, second_time FROM r) WHERE time IS NOT NULL)
SELECT r.*, a.position AS first_position, b.position AS second_position
FROM r LEFT JOIN o a ON a.doc_id = r.doc_id AND a.copy = 0 LEFT JOIN o b ON b.doc_id = r.doc_id AND b.copy = 1
"""

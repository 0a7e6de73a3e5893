"""Near-duplicate documents by b-bit MinHash (Li and König, 2010).

1. A document's word shingles become 64-bit hashes; equal sets form a class and
   only the class goes on. Each class gets 128 minima, of which the low 4 bits
   are kept and packed in eight longs, and 32 band keys, each made of 4 whole
   minima (sets of similarity 0.8 share no band with a chance of 5e-8).
2. Each band bucket links its members to one of them (a star, linear in the bucket). Packed signatures are compared by bit counts; the collision-
   corrected estimate drops pairs far below the threshold (5 standard errors).
3. What is left is confirmed on whole shingle sets, and components are formed.
4. A bucket that still spans several components is looked at again: each member
   outside its largest component meets the members of other components that its
   signature allows, and a forest of these meetings says who must be brought
   together, whole sets included, in tiles of bounded size. A tile confirms pairs of
   different components that signatures allow, the likeliest first, and skips those
   that links found before already connect. Nothing is left out, no list of partners
   is kept, and what a tile returns is linear in its members, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docfacts.llm.common import discard, few_tasks, narrowed, saved, small_batches
from docfacts.llm.components import components
from docfacts.llm.wordhash import column, mix, pieces

HASHES, BANDS, BITS = 128, 32, 4
ROWS = HASHES // BANDS
LONGS = HASHES * BITS // 64
#: Members of a bucket that a task holds at a time, on either side of a comparison; the least of a part that is cut for parallel work.
TILE, PART = 2048, 64
#: Tiles that a task of the shuffle gets at least where there are groups to cut.
TILES_A_TASK = 6
#: Shingles of a tile's sets, on either side.
TILE_SHINGLES = 4_000_000
#: Rows of an id table that may be broadcast (16 bytes each); a larger one is shuffled.
BROADCAST_ROWS = 1_000_000

_rng = np.random.default_rng(20100411)
_FLIP = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)
_TIMES = (_rng.integers(0, 1 << 32, HASHES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)


def shingle_sets(words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each row, ascending, end to end, and where each row's start (one more at the end)."""
    h = words.hashes()
    at, grams = words.grams(k, h)
    rows = words.doc[at]
    for c in range(1, k):  # too short for one shingle: the whole sequence is one
        few = np.flatnonzero(words.counts == c)
        if len(few):
            i = words.first[few]
            whole = h[i].copy()
            for j in range(1, c):
                whole = whole * np.uint64(0xC2B2AE3D27D4EB4F) + h[i + j]
            rows, grams = np.concatenate((rows, few)), np.concatenate((grams, mix(whole + np.uint64(c))))
    order = np.argsort(rows, kind="stable")
    rows, grams = rows[order], grams[order]
    edges = np.searchsorted(rows, np.arange(words.rows + 1))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        grams[a:b].sort()
    keep = np.ones(len(grams), bool)
    keep[1:] = (grams[1:] != grams[:-1]) | (rows[1:] != rows[:-1])
    return grams[keep], np.concatenate(([0], np.cumsum(keep)))[edges]


def minima(grams: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(sets, HASHES) minima of sets that each have a member."""
    x = (grams >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(starts), HASHES), np.uint32)
    for j in range(HASHES):
        out[:, j] = np.minimum.reduceat((x ^ _FLIP[j]) * _TIMES[j], starts)
    return out


def pack(low: np.ndarray) -> np.ndarray:
    """Low BITS of each minimum, 16 to a long."""
    lanes = (low & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(len(low), LONGS, 64 // BITS)
    return np.bitwise_or.reduce(lanes << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS)), axis=2)


def band_keys(m: np.ndarray) -> np.ndarray:
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(m), BANDS)).copy()
    for j in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + m[:, j::ROWS].astype(np.uint64) + np.uint64(1))
    return key


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """``docs`` (id, text) to (id, n, h1, h2, sig, bands); n is the set's size, h1 and h2 name the set; sig and bands are null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = column(batch, "id")
            for a, b, words in pieces(column(batch, "text"), lower=True):
                grams, edges = shingle_sets(words, k)
                n = np.diff(edges)
                some = np.flatnonzero(n)
                sums = np.zeros((2, b - a), np.uint64)
                sig, bands = np.zeros((b - a, LONGS), np.uint64), np.zeros((b - a, BANDS), np.uint64)
                if len(some):
                    starts = edges[:-1][some]
                    m = minima(grams, starts)
                    sig[some], bands[some] = pack(m), band_keys(m)
                    sums[0, some] = np.add.reduceat(mix(grams.copy()), starts)
                    sums[1, some] = np.add.reduceat(mix(grams ^ np.uint64(0xA5A5A5A55A5A5A5A)), starts)
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * w), pa.array(x.ravel().view(np.int64))) for x, w in ((sig, LONGS), (bands, BANDS))]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a), pa.array(n.astype(np.int64)), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), *lists], ["id", "n", "h1", "h2", "sig", "bands"]
                )

    return docs.mapInArrow(run, "id long, n long, h1 long, h2 long, sig array<long>, bands array<long>")


def estimate(a: Column, b: Column) -> Column:
    """Similarity of two packed signatures: share of equal lanes, less what chance makes equal."""
    differ = F.lit(0)
    for i in range(LONGS):
        x = a[i].bitwiseXOR(b[i])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        differ = differ + F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))
    chance = 2.0**-BITS
    return (1 - differ / float(HASHES) - chance) / (1 - chance)


def _least_estimate(percent: int) -> float:
    """Five standard errors below the threshold."""
    t, chance = percent / 100, 2.0**-BITS
    p = t + (1 - t) * chance
    return t - 5 * np.sqrt(p * (1 - p) / HASHES) / (1 - chance)


def confirm(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Those ``pairs`` (a, b) of ids whose whole sets are ``percent`` alike; a third column says so for every pair."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    few = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
    texts = docs.join(few, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = pa.concat_arrays([column(batch, "text_a"), column(batch, "text_b")])
            sets: list[np.ndarray] = []
            out = np.zeros(len(batch), bool)
            step = 64  # pairs whose sets are held at a time
            for lo in range(0, len(batch), step):
                m = min(step, len(batch) - lo)
                some = pa.concat_arrays([both.slice(lo, m), both.slice(len(batch) + lo, m)])
                sets = []
                for _, _, words in pieces(some, lower=True):
                    grams, edges = shingle_sets(words, k)
                    sets += [grams[edges[r] : edges[r + 1]] for r in range(words.rows)]
                for r in range(m):
                    out[lo + r] = _alike(sets[r], sets[m + r], percent)
            yield pa.RecordBatch.from_arrays([column(batch, "a"), column(batch, "b"), pa.array(out)], ["a", "b", "same"])

    a, b = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    return pairs.select("a", "b").join(a, "a").join(b, "b").mapInArrow(run, "a long, b long, same boolean")


def _likely(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of ``pairs`` (a, b), those whose sizes and packed signatures allow the threshold."""
    a = sets.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa"))
    b = sets.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb"))
    ok = (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & (estimate(F.col("sa"), F.col("sb")) >= _least_estimate(percent))
    return pairs.join(a, "a").join(b, "b").filter(ok).select("a", "b")


def _find(parent: dict, x):
    while parent.setdefault(x, x) != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def _parts(groups: DataFrame, sides: list[str]) -> dict[str, Column]:
    """Into how many parts each of ``sides`` (numbers of members) of a group is dealt, by its name and "_parts".

    A tile is a part of one side against a part of the other. A part has at most TILE
    members, and no tile is more than a small share of all groups' comparisons, however
    few and large the groups are; parts of under PART members aren't made for that.
    """
    work = groups.agg(F.sum(F.col(sides[0]).cast("double") * F.col(sides[-1]))).first()[0] or 1.0
    share = min((TILES_A_TASK * int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions")) / work) ** 0.5, 1 / PART)
    return {f"{x}_parts": F.ceil(F.greatest(F.col(x) / TILE, F.col(x) * share)).cast("int") for x in sides}


def _tiled(rows: DataFrame, *by: str):
    """Rows by tile, in all tasks of a shuffle: a tile is much work for its bytes, so few bytes are no reason for few tasks."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by).groupBy(*by)


def _similarity(sig: np.ndarray, one: np.ndarray) -> np.ndarray:
    """``estimate`` of packed signatures against one of them."""
    d = sig ^ one
    d |= d >> np.uint64(1)
    d |= d >> np.uint64(2)
    d &= np.uint64(0x1111111111111111)
    return (1 - np.bitwise_count(d).sum(axis=1) / HASHES - 2.0**-BITS) / (1 - 2.0**-BITS)


def _sigs(t: pa.Table) -> np.ndarray:
    return t["sig"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, LONGS)


def _meetings(members: DataFrame, percent: int) -> DataFrame:
    """(a, b): a forest of the members that may be linked across components.

    ``members`` (key, rep, n, sig, comp) are those of buckets with several
    components. Each member outside its bucket's largest component meets the
    members of other components whose sizes and signatures allow the threshold;
    a tile returns only pairs that connect what it has not connected yet, so at
    most as many as it has members, and every member that may be linked is in one.
    """
    sizes = members.groupBy("key", "comp").agg(F.count("*").alias("m"))
    buckets = saved(sizes.groupBy("key").agg(F.sum("m").alias("g"), F.max_by("comp", F.struct("m", "comp")).alias("top"), (F.sum("m") - F.max("m")).alias("s")), narrow=True)
    tiles = members.join(buckets.withColumns(_parts(buckets, ["g", "s"])), "key")
    deal = F.xxhash64("rep")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    targets = tiles.withColumns({"i": F.pmod(deal, F.col("g_parts")).cast("int"), "j": every("s_parts"), "asks": F.lit(False)})
    queries = tiles.filter("comp <> top").withColumns({"j": F.pmod(deal, F.col("s_parts")).cast("int"), "i": every("g_parts"), "asks": F.lit(True)})
    cols = ["key", "i", "j", "asks", "top", "rep", "n", "sig", "comp"]
    least = _least_estimate(percent)

    def run(t: pa.Table) -> pa.Table:
        asks = t["asks"].to_numpy()
        rep, n, comp = (t[c].to_numpy() for c in ("rep", "n", "comp"))
        sig, top = _sigs(t), t["top"][0].as_py()
        met = np.unique(rep, return_inverse=True)[1]  # one number for all that this tile has connected
        a, b = [], []
        x = np.flatnonzero(~asks)
        for i in np.flatnonzero(asks).tolist():
            # A pair of two askers is looked at by the one with the smaller id.
            ok = x[(comp[x] != comp[i]) & (met[x] != met[i]) & ((comp[x] == top) | (rep[x] > rep[i])) & (100 * np.minimum(n[x], n[i]) >= percent * np.maximum(n[x], n[i]))]
            if len(ok):
                ok = ok[_similarity(sig[ok], sig[i]) >= least]
            if len(ok):
                groups, first = np.unique(met[ok], return_index=True)
                a += [int(rep[i])] * len(groups)
                b += rep[ok[first]].tolist()
                met[np.isin(met, groups)] = met[i]
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return _tiled(targets.select(cols).unionByName(queries.select(cols)), "key", "i", "j").applyInArrow(run, "a long, b long")


def _met_links(homes: DataFrame, comps: DataFrame, sets: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) between components ``comps`` (rep, comp), enough to connect all that whole sets connect among members of one of ``homes`` (id, component)."""
    homes = homes.select(F.col("id").alias("rep"), F.col("component").alias("home"))
    people = saved(homes.join(sets.select("rep", "n", "h1", "sig"), "rep").join(comps, "rep"), narrow=True)
    tiles = people.groupBy("home").agg(F.count("*").alias("m"), F.sum("n").alias("shingles"))
    parts = F.greatest(_parts(tiles, ["m"])["m_parts"], F.ceil(F.col("shingles") / TILE_SHINGLES).cast("int"))
    people = people.join(tiles.select("home", parts.alias("t")), "home")
    few = F.broadcast(people) if tiles.agg(F.sum("m")).first()[0] <= BROADCAST_ROWS // 8 else people
    held = docs.join(few, docs["id"] == few["rep"]).withColumns({"part": F.pmod(F.xxhash64("rep"), F.col("t")).cast("int"), "other": F.explode(F.sequence(F.lit(0), F.col("t") - 1))})
    held = held.select("home", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), (F.col("part") <= F.col("other")).alias("left"), "comp", "n", "h1", "sig", "text")
    least = _least_estimate(percent)

    def run(t: pa.Table) -> pa.Table:
        own: list[np.ndarray] = []
        sums = []
        for _, _, words in pieces(t["text"].combine_chunks(), lower=True):
            grams, edges = shingle_sets(words, k)
            for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                own.append(grams[x:y])
                sums.append(np.add.reduce(mix(grams[x:y].copy())).view(np.int64))
        n, comp, left, sig = t["n"].to_numpy(), t["comp"].to_numpy(), t["left"].to_numpy(), _sigs(t)
        # Of rows that share an id, the one whose set it is.
        mine = (np.array([len(x) for x in own]) == n) & (np.array(sums, np.int64) == t["h1"].to_numpy())
        same = t["i"][0].as_py() == t["j"][0].as_py()
        across = np.flatnonzero(mine if same else mine & ~left)
        root, a, b = comp.copy(), [], []
        for q in np.flatnonzero(mine & left).tolist():
            ok = across[(root[across] != root[q]) & (100 * np.minimum(n[across], n[q]) >= percent * np.maximum(n[across], n[q]))]
            if same:
                ok = ok[ok > q]
            if not len(ok):
                continue
            like = _similarity(sig[ok], sig[q])
            order = np.argsort(-like, kind="stable")
            for p in ok[order[like[order] >= least]].tolist():
                if root[p] != root[q] and _alike(own[q], own[p], percent):
                    a.append(int(root[q])), b.append(int(root[p]))
                    root[root == root[p]] = root[q]
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return _tiled(held, "home", "i", "j").applyInArrow(run, "a long, b long")


def _alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common > 0 and 100 * common >= percent * (len(x) + len(y) - common)


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id): each document's set size and the smallest id that links lead to.

    Two documents are linked if their sets of distinct ``shingle``-word runs
    (A-Z lower-cased) are at least ``percent`` alike by Jaccard similarity. Fewer
    words than that count as one run.

    Defined cases: a null or blank text has an empty set and is linked with
    nothing; a row with a null id can't be named by a link, so its component is
    null; rows that repeat an id are rows of their own, alike in id; an empty
    table gives no rows; other columns are ignored, whatever their names.
    """
    small_batches(df.sparkSession)
    docs = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    signed = saved(signatures(few_tasks(docs, docs), shingle))
    named = signed.filter("id is not null and n > 0")
    sets = saved(named.groupBy("n", "h1", "h2").agg(F.min("id").alias("rep"), F.first("sig").alias("sig"), F.first("bands").alias("bands")), narrow=True)
    bands = sets.select("rep", F.posexplode("bands").alias("band", "key"))
    buckets = bands.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1")
    members = saved(bands.join(buckets, "key"), narrow=True)
    # Each bucket's lead is its most popular member, the one that meets most others in all of its buckets: in a
    # group of copies, the text that they were made from. Each member asks the most popular of its leads.
    popular = members.groupBy("rep").agg(F.sum("m").alias("meets"))
    first = F.struct(F.col("meets"), (-F.col("rep")).alias("rep"))
    leads = members.join(popular, "rep").groupBy("key").agg(F.max(first).alias("lead"))
    stars = members.join(leads, "key").groupBy("rep").agg((-F.max("lead")["rep"]).alias("lead")).filter("rep <> lead")
    pairs = stars.select(F.least("rep", "lead").alias("a"), F.greatest("rep", "lead").alias("b")).distinct()
    tried = confirm(saved(_likely(pairs, sets, percent), narrow=True), docs, shingle, percent)
    linked = components(tried.filter("same").select("a", "b"))
    comps = saved(members.select("rep").distinct().join(linked, F.col("rep") == F.col("id"), "left").select("rep", F.coalesce("component", "rep").alias("comp")), narrow=True)
    spread = members.select("key", "rep").join(comps, "rep")
    mixed = spread.groupBy("key").agg(F.min("comp").alias("_a"), F.max("comp").alias("_b")).filter("_a <> _b").select("key")
    homes = components(_meetings(spread.join(mixed, "key").join(sets.select("rep", "n", "sig"), "rep"), percent))
    if not homes.isEmpty():
        more = components(_met_links(homes, comps, sets, docs, shingle, percent)).select(F.col("id").alias("comp"), "component")
        comps = comps.join(more, "comp", "left").select("rep", F.coalesce("component", "comp").alias("comp"))
    discard(members)
    classes = sets.select("rep", "n", "h1", "h2").join(comps, "rep", "left").select("n", "h1", "h2", F.coalesce("comp", "rep").alias("_c"))
    # Empty sets are no class: they would all meet in one key.
    empty = signed.filter("n = 0").select("id", "n", F.col("id").alias("_c"))
    found = signed.filter("n > 0").select("id", "n", "h1", "h2").join(classes, ["n", "h1", "h2"], "left").select("id", "n", "_c").unionByName(empty)
    return narrowed(found).select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("_c", "id")).alias("component_id"))


def op9(spark, sf_dir: str) -> DataFrame:
    """A row per document; a null id has neither a component nor a say in ``kept``: both are null."""
    from docfacts.llm.common import read

    found = near_duplicates(read(spark, sf_dir, "documents"), shingle=4)
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))


OP9_SQL = r"""
WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(list_slice(w, i, i + 3), ' ')))
                          WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
n AS (SELECT doc_id, len(s) AS n, s FROM g),
x AS (SELECT doc_id, n, unnest(s) AS s FROM n),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.s = b.s AND a.doc_id < b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
r AS (SELECT doc_id AS id, doc_id AS c FROM n UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, m.c AS component_id, n.doc_id = m.c AS kept
FROM n JOIN (SELECT id, min(c) AS c FROM r GROUP BY id) m ON m.id = n.doc_id
"""

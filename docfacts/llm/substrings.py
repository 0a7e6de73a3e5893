"""Removal of word passages that occur more than once, with a count-min prefilter.

A window is ``window`` consecutive words of a document. Each window has an anchor:
the run of (window + 1) // 2 words in it with the smallest hash, the leftmost on a
tie. Equal windows have equal anchors at different places, so a window can only be
repeated if its anchor is; there are about ten times fewer anchors than windows.

1. Each partition makes a sparse count-min sketch of its anchors (two rows of
   counters, saturating at two). Sketches are merged slice by slice. A counter
   never underestimates, so an anchor that occurs twice is always seen.
2. A second pass over the texts takes the windows whose anchor is estimated
   repeated and groups them exactly, by anchor and window hash (128 bits). What a
   batch of documents itself holds twice is decided there and sent on once, so a
   passage of a third of all documents costs a row a batch.
3. Repeated windows return to their documents as ranges of words.

The merged sketch is broadcast. Its size follows the text up to ``MOST_CELLS``;
beyond that the estimate grows coarser and more windows are grouped exactly, but
the result is the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docfacts.llm.common import few_tasks, small_batches
from docfacts.llm.wordhash import buffers, column, mix, pieces

#: Rows of the sketch; counters in a row at least and at most (2 bits of 2^28 counters are 64 MB for both rows).
DEPTH, LEAST_CELLS, MOST_CELLS = 2, 1 << 20, 1 << 28
#: Text of a bucket of the exact pass, and windows that a task gathers before it sends them.
BUCKET_BYTES, BATCH_WINDOWS = 8 << 20, 1 << 20
_SEEDS = (np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9FB21C651E98DF25))


def anchored(words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, hash, anchor hash) of each window; windows with one anchor are neighbours."""
    empty = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    if len(words) < window:
        return empty
    h = words.hashes()
    starts, whole = words.grams(window, h)
    if not len(starts):
        return empty
    k = (window + 1) // 2
    at, runs = words.grams(k, h)
    every = np.full(len(h) - k + 1, np.iinfo(np.uint64).max, np.uint64)
    every[at] = runs
    span = window - k + 1
    first = np.lib.stride_tricks.sliding_window_view(every, span)[starts].argmin(axis=1) + starts if span > 1 else starts
    return starts, whole, np.stack((every[first], first.astype(np.uint64)))


def _cells(anchors: np.ndarray, row: int, bits: int) -> np.ndarray:
    return mix(anchors ^ _SEEDS[row]) >> np.uint64(64 - bits)


def _slices(bits: int) -> int:
    """Bits of a cell's number that name its slice."""
    return max(6, bits - 20)


def sketch(docs: DataFrame, window: int, bits: int) -> list[np.ndarray]:
    """For each row of the merged sketch, a bit per counter: set if its count is two or more."""
    cut = np.uint64(bits - _slices(bits))

    def flush(found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        anchors = np.concatenate(found)
        names, blobs = [], []
        for row in range(DEPTH):
            cells, counts = np.unique(_cells(anchors, row, bits), return_counts=True)
            code = ((cells & np.uint64((1 << int(cut)) - 1)) << np.uint64(1) | (counts > 1).astype(np.uint64)).astype(np.uint32)
            part = (cells >> cut).astype(np.int64)
            edges = np.searchsorted(part, np.arange((1 << _slices(bits)) + 1))
            for s in np.flatnonzero(np.diff(edges)):
                names.append(row << _slices(bits) | int(s))
                blobs.append(code[edges[s] : edges[s + 1]].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(blobs, pa.binary())], ["slice", "cells"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = [], 0
        for batch in batches:
            for _, _, words in pieces(column(batch, "text"), lower=False):
                _, _, anchors = anchored(words, window)
                if len(anchors):
                    new = np.ones(anchors.shape[1], bool)
                    new[1:] = anchors[1, 1:] != anchors[1, :-1]
                    found.append(anchors[0, new])
                    n += len(found[-1])
            if n >= BATCH_WINDOWS:
                yield from flush(found)
                found, n = [], 0
        if n:
            yield from flush(found)

    def merge(t: pa.Table) -> pa.Table:
        seen = np.zeros(1 << int(cut), np.uint8)
        for blob in t["cells"]:
            code = np.frombuffer(blob.as_py(), np.uint32)
            cells = code >> np.uint32(1)
            seen[cells] = np.minimum(seen[cells] + 1 + (code & np.uint32(1)).astype(np.uint8), 2)
        return pa.table([pa.array([t["slice"][0].as_py()], pa.int32()), pa.array([np.packbits(seen > 1).tobytes()], pa.binary())], ["slice", "bits"])

    merged = docs.select("text").mapInArrow(count, "slice int, cells binary").groupBy("slice").applyInArrow(merge, "slice int, bits binary")
    rows = [np.zeros((1 << bits) // 8, np.uint8) for _ in range(DEPTH)]
    each = (1 << int(cut)) // 8
    for got in merged.collect():  # at most DEPTH * MOST_CELLS / 8 bytes
        row, s = got["slice"] >> _slices(bits), got["slice"] & ((1 << _slices(bits)) - 1)
        rows[row][s * each : (s + 1) * each] = np.frombuffer(got["bits"], np.uint8)
    return rows


def _runs(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs, from a flag per item that says it goes on from the one before."""
    starts = np.flatnonzero(~same)
    return starts, np.append(starts[1:], len(same))


_KEYS = ("id", "th", "anchor", "start", "whole")


def _repeated(anchor: np.ndarray, whole: np.ndarray, twice: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a flag per window: its words occur again here, or it says so itself; an index of one window for each group)."""
    order = np.lexsort((whole, anchor))
    a, w = anchor[order], whole[order]
    same = np.zeros(len(a), bool)
    same[1:] = (a[1:] == a[:-1]) & (w[1:] == w[:-1])
    starts, ends = _runs(same)
    flag = (ends - starts > 1) | np.logical_or.reduceat(twice[order], starts)
    out = np.zeros(len(a), bool)
    out[order] = np.repeat(flag, ends - starts)
    return out, order[starts]


def _ranges(ids, th, start) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive window starts of one document: (id, th, first start, number)."""
    order = np.lexsort((start, ids, th))
    ids, th, start = ids[order], th[order], start[order]
    same = np.zeros(len(ids), bool)
    same[1:] = (ids[1:] == ids[:-1]) & (th[1:] == th[:-1]) & (start[1:] == start[:-1] + 1)
    s, e = _runs(same)
    return ids[s], th[s], start[s], e - s


def repeats(docs: DataFrame, window: int) -> DataFrame:
    """``docs`` (id, th, text; ``th`` tells texts of one id apart) to (id, th, start, n): runs of n repeated windows from word ``start`` on."""
    spark = docs.sparkSession
    small_batches(spark)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = int(np.clip(size // 16, LEAST_CELLS, MOST_CELLS)).bit_length()
    bits = min(bits, MOST_CELLS.bit_length() - 1)
    buckets = max(64, size // BUCKET_BYTES)
    shared = spark.sparkContext.broadcast(sketch(docs, window, bits))

    def flush(found: list[tuple], turn: int) -> Iterator[pa.RecordBatch]:
        ids, th, start, whole, anchor = (np.concatenate(x) for x in zip(*found, strict=True))
        twice, one = _repeated(anchor, whole, np.zeros(len(ids), bool))
        # What occurs twice here goes on once, without a document; the rest with it.
        at, w = anchor[one], whole[one]
        bucket = (mix(at ^ _SEEDS[0]) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
        rows = []
        for b in np.flatnonzero(np.diff(edges)):
            i = order[edges[b] : edges[b + 1]]
            j = one[i]
            rows.append((int(b), *(x.tobytes() for x in (ids[j], th[j], start[j].astype(np.int32), w[i], at[i], twice[j]))))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int32() if not k else pa.binary()) for k in range(7)], ["bucket", "id", "th", "start", "whole", "anchor", "twice"])
        if twice.any():
            i, t, s, n = _ranges(ids[twice], th[twice], start[twice])
            for lo in range(0, len(i), 50_000):  # decided here: nothing but the ranges goes on
                hi = slice(lo, lo + 50_000)
                blobs = [x[hi].tobytes() for x in (i, t, s.astype(np.int32), n.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([pa.array([(turn + lo // 50_000) % buckets], pa.int32()), *(pa.array([x], pa.binary()) for x in blobs[:3]), pa.array([blobs[3]], pa.binary()), pa.array([None], pa.binary()), pa.array([None], pa.binary())], ["bucket", "id", "th", "start", "whole", "anchor", "twice"])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rows, found, n, turn = shared.value, [], 0, (TaskContext.get().partitionId() if TaskContext.get() else 0) * 7
        for batch in batches:
            ids, th = (column(batch, c).to_numpy() for c in ("id", "th"))
            for a, _, words in pieces(column(batch, "text"), lower=False):
                start, whole, anchors = anchored(words, window)
                if not len(start):
                    continue
                keep = np.ones(len(start), bool)
                for row in range(DEPTH):
                    cell = _cells(anchors[0], row, bits)
                    keep &= (rows[row][cell >> np.uint64(3)] >> (np.uint8(7) - (cell & np.uint64(7)).astype(np.uint8))) & 1 > 0
                start, whole, anchor = start[keep], whole[keep], anchors[0, keep]
                doc = words.doc[start]
                found.append((ids[a + doc], th[a + doc], start - words.first[doc], whole, anchor))
                n += len(start)
                if n >= BATCH_WINDOWS:
                    yield from flush(found, turn)
                    found, n, turn = [], 0, turn + 1
        if n:
            yield from flush(found, turn)

    def group(t: pa.Table) -> pa.Table:
        parts: list[tuple] = []
        done: list[tuple] = []
        for row in zip(*(t[c].to_pylist() for c in ("id", "th", "start", "whole", "anchor", "twice")), strict=True):
            ids, th, start = np.frombuffer(row[0], np.int64), np.frombuffer(row[1], np.int64), np.frombuffer(row[2], np.int32)
            if row[4] is None:
                done.append((ids, th, start, np.frombuffer(row[3], np.int32)))
            else:
                parts.append((ids, th, start, np.frombuffer(row[3], np.uint64), np.frombuffer(row[4], np.uint64), np.frombuffer(row[5], bool)))
        if parts:
            ids, th, start, whole, anchor, twice = (np.concatenate(x) for x in zip(*parts, strict=True))
            again, _ = _repeated(anchor, whole, twice)
            again &= ~twice
            if again.any():
                done.append(_ranges(ids[again], th[again], start[again]))
        cols = [np.concatenate(x) for x in zip(*done, strict=True)] if done else [np.zeros(0, np.int64)] * 4
        return pa.table([pa.array(x, y) for x, y in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], ["id", "th", "start", "n"])

    sent = docs.mapInArrow(emit, "bucket int, id binary, th binary, start binary, whole binary, anchor binary, twice binary")
    return sent.groupBy("bucket").applyInArrow(group, "id long, th long, start int, n int")


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = 35) -> DataFrame:
    """(id, n_words, n_removed, kept): ``kept`` is what is left of each text, its words joined by one space; null for a null text.

    A word goes if a window that covers it occurs anywhere else, in another
    document or in the same one. Windows are judged on the input.

    Defined cases: a null text has no words; a text shorter than a window loses
    nothing; repeated rows are documents of their own, so they lose every window;
    null ids are ids like any other; an empty table gives no rows; other columns
    are ignored, whatever their names.
    """
    docs = df.select(F.col(key).alias("own"), *_keys(key, text), F.col(text).alias("text"))
    return _kept(docs, window, tidy=True).select(F.col("own").alias(key), "n_words", "n_removed", F.col("text").alias("kept"))


def cleaned(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = 35) -> DataFrame:
    """The rows of ``df``, all columns, with repeated passages cut out of ``text``; other texts stay as they are."""
    rest = F.struct(*[F.col(c) for c in df.columns if c != text])
    docs = df.select(rest.alias("own"), *_keys(key, text), F.col(text).alias("text"))
    done = _kept(docs, window, tidy=False)
    return done.select(*[(F.col("text") if c == text else F.col("own")[c]).alias(c) for c in df.columns])


def _keys(key: str, text: str) -> list:
    return [F.coalesce(F.col(key).cast("long"), F.lit(0)).alias("id"), F.xxhash64(F.col(key).isNull(), F.col(text)).alias("th")]


def _kept(docs: DataFrame, window: int, tidy: bool) -> DataFrame:
    """``docs`` (own, id, th, text) to (own, n_words, n_removed, text); ``tidy`` joins the words of texts that lose nothing, too."""
    found = repeats(docs.select("id", "th", "text"), window).groupBy("id", "th").agg(F.collect_list(F.struct("start", "n")).alias("ranges"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranges, texts = column(batch, "ranges"), column(batch, "text")
            data, offsets = buffers(texts, lower=False)
            raw, null = data.tobytes(), texts.is_null().to_pylist()
            n_words, n_removed, kept = [], [], []
            for r in range(len(batch)):
                whole = raw[offsets[r] : offsets[r + 1]]
                words = whole.split()
                n_words.append(len(words))
                gone = ranges[r].as_py()
                if gone:
                    keep = np.ones(len(words), bool)
                    for g in gone:
                        keep[g["start"] : g["start"] + g["n"] + window - 1] = False
                    words = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
                n_removed.append(n_words[-1] - len(words))
                kept.append(None if null[r] else b" ".join(words) if tidy or gone else whole)
            yield pa.RecordBatch.from_arrays(
                [column(batch, "own"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["own", "n_words", "n_removed", "text"]
            )

    numbers = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("text", T.StringType())]
    joined = docs.join(found, ["id", "th"], "left").select("own", "text", "ranges")
    # A task writes a file, and for each the JVM may start processes: as many tasks as the texts call for, not as the shuffle has.
    return few_tasks(joined, docs).mapInArrow(cut, T.StructType([docs.schema["own"], *numbers]))


def op6(spark, sf_dir: str) -> DataFrame:
    from docfacts.llm.common import read

    done = remove_repeats(read(spark, sf_dir, "documents"), window=35)
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT r, unnest(range(1, len(w) - 33)) AS i, w FROM w WHERE len(w) >= 35),
h AS (SELECT r, i, md5(array_to_string(list_slice(w, i, i + 34), ' ')) AS h FROM x),
d AS (SELECT h FROM h GROUP BY h HAVING count(*) > 1),
s AS (SELECT h.r, list(h.i) AS s FROM h JOIN d ON d.h = h.h GROUP BY h.r),
c AS (SELECT s.r, list_distinct(flatten(list_transform(s.s, lambda i: range(i, i + 35)))) AS c FROM s),
k AS (SELECT w.r, w.doc_id, w.w, len(w.w) AS n, c.c FROM w LEFT JOIN c ON c.r = w.r),
u AS (SELECT r, unnest(range(1, n + 1)) AS i, unnest(w) AS word FROM k WHERE c IS NOT NULL),
g AS (SELECT c.r, unnest(c.c) AS i FROM c),
f AS (SELECT u.r, string_agg(u.word, ' ' ORDER BY u.i) AS t, count(*) AS m FROM u ANTI JOIN g ON g.r = u.r AND g.i = u.i GROUP BY u.r)
SELECT k.doc_id, CAST(k.n AS BIGINT) AS n_words, CAST(CASE WHEN k.c IS NULL THEN 0 ELSE k.n - coalesce(f.m, 0) END AS BIGINT) AS n_removed,
       sha256(CASE WHEN k.c IS NULL THEN array_to_string(k.w, ' ') ELSE coalesce(f.t, '') END) AS kept_sha256
FROM k LEFT JOIN f ON f.r = k.r
"""

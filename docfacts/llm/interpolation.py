"""Language-model scores by deleted interpolation (Jelinek and Mercer, 1980), of order two.

    P(w | h) = a2(b) c(h, w) / c(h)  +  a1(b) c(w) / N  +  a0(b) / (V + 1)

b is the bucket of the context's training frequency c(h), by powers of two. The
weights a(b) come from expectation-maximisation on deleted counts: each training
bigram is held out in turn, its own occurrence taken from c(h, w), c(h), c(w), N.

Words and bigrams are counted in buckets of hashes. A batch of documents is one
row per bucket that it touches (packed arrays), so a bucket's rows are counted
by numpy in bounded memory. Counts of the ``FREQUENT`` commonest words are
broadcast; the rest are asked for and answered by bucket. Bigrams that make up
more than one in ``HOT`` tokens (there are fewer than ``HOT`` of them) are scored
where they stand, so that no bucket grows with the number of documents alone.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docfacts.llm.common import remainder, saved, small_batches
from docfacts.llm.wordhash import Places, column, mix, pieces

#: Words whose counts are broadcast (16 bytes each) and bound on bigrams scored from a broadcast.
FREQUENT, HOT = 1 << 20, 1 << 16  # every word of a hot bigram is a frequent one, as FREQUENT is over twice HOT
#: Tokens and documents of a batch; text of a bucket.
BATCH_TOKENS, BATCH_DOCS, BUCKET_BYTES = 800_000, 60_000, 8 << 20
#: Buckets of context frequency; steps of the grid that deleted counts are summed on, per power of two; rounds of the estimation.
CONTEXTS, GRID, ROUNDS = 18, 8, 60
BEGIN, END = np.uint64(1), np.uint64(2)
_PAIR = np.uint64(0x9E3779B97F4A7C15)
_CELLS = 40 * GRID  # probabilities down to 2^-40; one cell more for zero


def _bucket(c: np.ndarray) -> np.ndarray:
    return np.minimum(np.where(c > 0, np.log2(np.maximum(c, 1)).astype(np.int64) + 1, 0), CONTEXTS - 1)


def _lookup(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of hashes in ascending ``keys``, -1 where absent."""
    return Places(keys)(wanted)


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order that sorts, starts of equal keys in it)."""
    order = np.argsort(keys)
    k = keys[order]
    return order, np.flatnonzero(np.concatenate((np.ones(min(1, len(k)), bool), k[1:] != k[:-1])))


def _split(bucket: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(edges)):
        yield int(b), order[edges[b] : edges[b + 1]]


def _to(kind, blobs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), kind)


def _batch(rows: list[tuple], names: list[str], types: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)


def tokens(batches: Iterator[pa.RecordBatch], train_only: bool) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, train flags, token hashes, row of each token) of some documents at a time; each document ends with END."""
    got, n, docs = [], 0, 0

    def put():
        base = np.cumsum([0] + [len(g[0]) for g in got])
        return pa.concat_arrays([g[0] for g in got]), *(np.concatenate([g[i] for g in got]) for i in (1, 2)), np.concatenate([g[3] + b for g, b in zip(got, base, strict=False)])

    for batch in batches:
        if train_only:
            batch = batch.filter(column(batch, "train"))
        ids, train = column(batch, "id"), column(batch, "train").to_numpy(zero_copy_only=False)
        for a, b, words in pieces(column(batch, "text"), lower=True):
            for lo in range(0, b - a, BATCH_DOCS):  # empty texts take no bytes
                hi = min(b - a, lo + BATCH_DOCS)
                w0, w1 = words.first[lo], words.first[hi]
                counts = words.counts[lo:hi]
                h = np.full(int(w1 - w0) + hi - lo, END, np.uint64)
                row = np.repeat(np.arange(hi - lo), counts + 1)
                h[np.arange(int(w1 - w0)) + words.doc[w0:w1] - lo] = (words.hashes() if hi - lo == b - a else words.hashes()[w0:w1]) | np.uint64(1 << 63)
                if got and (n + len(h) > BATCH_TOKENS or docs + hi - lo > BATCH_DOCS):
                    yield put()
                    got, n, docs = [], 0, 0
                got.append((ids.slice(a + lo, hi - lo), train[a + lo : a + hi], h, row))
                n, docs = n + len(h), docs + hi - lo
    if got:
        yield put()


def word_counts(docs: DataFrame, buckets: int) -> DataFrame:
    """A row per bucket of training words: (bucket, word, count) as arrays in binary, with their total and number."""

    def count(batches):
        for _, _, h, _ in tokens(batches, train_only=True):
            word, n = np.unique(h, return_counts=True)
            rows = [(b, word[i].tobytes(), n[i].astype(np.uint32).tobytes()) for b, i in _split((mix(word) % np.uint64(buckets)).astype(np.int64), buckets)]
            yield _batch(rows, ["bucket", "word", "n"], [pa.int32(), pa.binary(), pa.binary()])

    def add(t: pa.Table) -> pa.Table:
        word, n = _to(np.uint64, t["word"].to_pylist()), _to(np.uint32, t["n"].to_pylist())
        order, starts = _groups(word)
        sums = np.add.reduceat(n[order].astype(np.int64), starts)
        return pa.table(
            [pa.array([t["bucket"][0].as_py()], pa.int32()), pa.array([word[order][starts].tobytes()]), pa.array([sums.tobytes()]), pa.array([int(sums.sum())]), pa.array([len(starts)])],
            ["bucket", "word", "n", "total", "kinds"],
        )

    return docs.mapInArrow(count, "bucket int, word binary, n binary").groupBy("bucket").applyInArrow(add, "bucket int, word binary, n binary, total long, kinds long")


def frequent(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (ascending) and counts of the commonest words: all whose count is at least the smallest that at most ``most`` words reach."""
    def histogram(batches):
        for batch in batches:
            for blob in column(batch, "n").to_pylist():
                n = np.frombuffer(blob, np.int64)
                size, many = np.unique(np.where(n < 1024, n, 1 << np.log2(np.maximum(n, 1)).astype(np.int64)), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(size, pa.int64()), pa.array(many, pa.int64())], ["size", "many"])

    least, held = 1 << 62, 0
    for r in counts.select("n").mapInArrow(histogram, "size long, many long").groupBy("size").agg(F.sum("many").alias("many")).orderBy(F.desc("size")).collect():  # some thousand rows at most
        if held + r["many"] > most:
            break
        least, held = r["size"], held + r["many"]

    def pick(batches):
        for batch in batches:
            for word, n in zip(column(batch, "word").to_pylist(), column(batch, "n").to_pylist(), strict=True):
                w, c = np.frombuffer(word, np.uint64), np.frombuffer(n, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([w[c >= least].tobytes()]), pa.array([c[c >= least].tobytes()])], ["word", "n"])

    got = counts.select("word", "n").mapInArrow(pick, "word binary, n binary").collect()  # at most ``most`` words
    word, n = _to(np.uint64, [r["word"] for r in got]), _to(np.int64, [r["n"] for r in got])
    order = np.argsort(word)
    return word[order], n[order]


def _coded(h: np.ndarray, known: Places) -> np.ndarray:
    """Words as their places among the known ones; the others keep their hash (its highest bit is set)."""
    at = known(h)
    return np.where(at >= 0, at.astype(np.uint64), h)


def _contexts(code: np.ndarray, row: np.ndarray, begin: int) -> np.ndarray:
    prev = np.empty_like(code)
    prev[1:] = code[:-1]
    prev[np.flatnonzero(np.concatenate((np.ones(min(1, len(row)), bool), row[1:] != row[:-1])))] = begin
    return prev


def _pair(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(mix(h * _PAIR + np.uint64(1)) + w * _PAIR)


def _pair_bucket(p: np.ndarray, buckets: int) -> np.ndarray:
    return ((p >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)


_TAIL = np.uint64(1 << 63)


class _Shared:
    """What tasks know: commonest words and their counts, N, V, buckets, and hot bigrams with their log-probabilities once there are."""

    def __init__(self, known, n, total, kinds, buckets):
        self.known, self.n, self.total, self.kinds, self.buckets = known, n, total, kinds, buckets
        self.begin = int(_lookup(known, np.array([BEGIN]))[0])
        self.hot, self.hot_log = np.zeros(0, np.uint64), np.zeros(0)

    def log10(self, weights: np.ndarray, pair: np.ndarray, ch: np.ndarray, cw: np.ndarray) -> np.ndarray:
        a = weights[_bucket(ch)]
        return np.log10(a[:, 2] * (pair / np.maximum(ch, 1)) + a[:, 1] * (cw / max(self.total, 1)) + a[:, 0] / (self.kinds + 1))


def answers(docs: DataFrame, counts: DataFrame, shared, word_buckets: int, train_only: bool) -> DataFrame:
    """Training counts of uncommon words, for each bucket of bigrams that has one: (bucket, word, n) with arrays in binary."""

    def ask(batches):
        s = shared.value
        known = Places(s.known)
        for _, _, h, row in tokens(batches, train_only):
            code = _coded(h, known)
            prev = _contexts(code, row, s.begin)
            some = np.flatnonzero((code >= _TAIL) | (prev >= _TAIL))
            pb = _pair_bucket(_pair(prev[some], code[some]), s.buckets)
            word, at = np.concatenate((code[some], prev[some])), np.concatenate((pb, pb))
            word, at = word[word >= _TAIL], at[word >= _TAIL]
            order = np.lexsort((word, at))
            word, at = word[order], at[order]
            new = np.concatenate((np.ones(min(1, len(word)), bool), (word[1:] != word[:-1]) | (at[1:] != at[:-1])))
            word, at = word[new], at[new]
            yield _batch([(b, word[i].tobytes(), at[i].astype(np.uint32).tobytes()) for b, i in _split((mix(word) % np.uint64(word_buckets)).astype(np.int64), word_buckets)], ["wb", "word", "pb"], [pa.int32(), pa.binary(), pa.binary()])

    def answer(asked: pa.Table, have: pa.Table) -> pa.Table:
        out = []
        if len(asked):
            word, at = _to(np.uint64, asked["word"].to_pylist()), _to(np.uint32, asked["pb"].to_pylist())
            order = np.lexsort((word, at))
            word, at = word[order], at[order]
            new = np.concatenate((np.ones(1, bool), (word[1:] != word[:-1]) | (at[1:] != at[:-1])))
            word, at = word[new], at[new]
            keys, n = _to(np.uint64, have["word"].to_pylist()), _to(np.int64, have["n"].to_pylist())
            place = _lookup(keys, word)
            hit = place >= 0  # a word that isn't among the answers has no training count
            word, at, n = word[hit], at[hit], n[place[hit]]
            out = [(b, word[i].tobytes(), n[i].tobytes()) for b, i in _split(at.astype(np.int64), shared.value.buckets)]
        return pa.table([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int32(), pa.binary(), pa.binary()))], ["bucket", "word", "n"])

    asked = docs.mapInArrow(ask, "wb int, word binary, pb binary")
    have = counts.select(F.col("bucket").alias("wb"), "word", "n")
    return asked.groupBy("wb").cogroup(have.groupBy("wb")).applyInArrow(answer, "bucket int, word binary, n binary")


_SENT = ["bucket", "batch", "kind", "h", "w", "tail", "train", "times", "docs"]
_SENT_TYPES = [pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 6]
_SENT_SCHEMA = "bucket int, batch long, kind int, h binary, w binary, tail binary, train binary, times binary, docs binary"


def _planes(x: np.ndarray) -> bytes:
    """32-bit numbers byte by byte, all lowest bytes first: runs of equal bytes compress."""
    return np.ascontiguousarray(x.astype(np.uint32).view(np.uint8).reshape(-1, 4).T).tobytes()


def _from_planes(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(4, -1).T).view(np.uint32).ravel()


def _codes(s: _Shared, h: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bigrams as 32-bit places, uncommon words after the common ones in a list of their own: (order, steps of context places in that order, word places, the list)."""
    tail = np.unique(np.concatenate((h[h >= _TAIL], w[w >= _TAIL])))
    ch, cw = (np.where(x >= _TAIL, np.uint64(len(s.known)) + np.searchsorted(tail, x).astype(np.uint64), x) for x in (h, w))
    order = np.argsort(ch << np.uint64(32) | cw)
    return order, np.diff(ch[order], prepend=np.uint64(0)), cw[order], tail


def send(docs: DataFrame, shared, scoring: bool) -> DataFrame:
    """Bigrams of each batch by bucket, with their training counts; for scoring, with the documents that hold them, too."""

    def emit(batches):
        s = shared.value
        known, hot = Places(s.known), Places(s.hot)
        part = TaskContext.get().partitionId() if TaskContext.get() else 0
        for turn, (ids, train, h, row) in enumerate(tokens(batches, train_only=not scoring)):
            batch = part << 32 | turn
            code = _coded(h, known)
            prev = _contexts(code, row, s.begin)
            p = _pair(prev, code)
            if scoring:
                common = code < _TAIL
                c = np.where(common, s.n[np.where(common, code, 0).astype(np.int64)], 0)
                base = np.where(common, np.log10((c + 1) / (s.total + s.kinds + 1)), 0.0)
                at = hot(p)
                logs = np.where(at >= 0, s.hot_log[np.maximum(at, 0)] if len(s.hot) else 0.0, 0.0)
                sums = [np.bincount(row, x, len(ids)) for x in (np.ones(len(row)), c > 0, base, logs)]
                plain = [ids.fill_null(0).to_numpy(zero_copy_only=False).tobytes(), *(x.tobytes() for x in sums), np.stack((train, ids.is_null().to_numpy(zero_copy_only=False))).astype(np.uint8).tobytes()]
                yield _batch([(batch * 31 % s.buckets, batch, 1, *plain)], _SENT, _SENT_TYPES)
                cold = np.flatnonzero(at < 0)
                p, prev, code, row = p[cold], prev[cold], code[cold], row[cold]
            order, starts = _groups(p)
            if not len(starts):
                continue
            times = np.diff(np.append(starts, len(order)))
            many = np.add.reduceat(train[row[order]].astype(np.int64), starts)
            first = order[starts]
            edges = np.append(starts, len(order))
            rows = []
            for b, i in _split(_pair_bucket(p[first], s.buckets), s.buckets):
                by, steps, cw, tail = _codes(s, prev[first[i]], code[first[i]])
                i = i[by]
                held = times[i]
                inside = order[np.repeat(edges[i] - np.concatenate(([0], np.cumsum(held)[:-1])), held) + np.arange(held.sum())] if scoring else order[:0]
                blobs = _planes(steps), _planes(cw), tail.tobytes(), _planes(many[i]), _planes(held if scoring else held[:0]), row[inside].astype(np.uint16).tobytes()
                rows.append((b, batch, 0, *blobs))
                if len(rows) == 64:
                    yield _batch(rows, _SENT, _SENT_TYPES)
                    rows = []
            if rows:
                yield _batch(rows, _SENT, _SENT_TYPES)

    return docs.mapInArrow(emit, _SENT_SCHEMA)


def _bucket_counts(s: _Shared, sent: pa.Table, told: pa.Table):
    """(context, word, c(h, w), c(h), c(w)) of each bigram row of a bucket, the rows' lengths, and groups of equal bigrams."""
    h, w, lens = [], [], []
    for row in zip(*(sent[c].to_pylist() for c in ("h", "w", "tail")), strict=True):
        tail = np.frombuffer(row[2], np.uint64)
        for out, x in ((h, np.cumsum(_from_planes(row[0]), dtype=np.uint64)), (w, _from_planes(row[1]).astype(np.uint64))):
            far = x >= len(s.known)
            x[far] = tail[(x[far] - np.uint64(len(s.known))).astype(np.int64)]
            out.append(x)
        lens.append(len(h[-1]))
    h, w = np.concatenate(h), np.concatenate(w)
    train = np.concatenate([_from_planes(x) for x in sent["train"].to_pylist()]).astype(np.int64)
    order, starts = _groups(_pair(h, w))
    sums = np.add.reduceat(train[order], starts)
    pair = np.empty(len(h), np.int64)
    pair[order] = np.repeat(sums, np.diff(np.append(starts, len(h))))
    keys, n = _to(np.uint64, told["word"].to_pylist()), _to(np.int64, told["n"].to_pylist())
    by = np.argsort(keys)
    keys, n = keys[by], n[by]

    def count(x):
        far = x >= _TAIL
        place = _lookup(keys, x[far])
        out = np.zeros(len(x), np.int64)
        out[~far] = s.n[x[~far].astype(np.int64)]
        out[far] = np.where(place >= 0, n[np.maximum(place, 0)], 0) if len(n) else 0
        return out

    return h, w, pair, count(h), count(w), lens, order[starts]


def deleted_counts(sent: DataFrame, told: DataFrame, shared) -> DataFrame:
    """Training bigrams held out in turn, summed on a grid of (context bucket, bigram and word probability); and hot bigrams (cell is null)."""

    def grid(p: np.ndarray) -> np.ndarray:
        return np.where(p > 0, np.minimum(np.rint(-GRID * np.log2(np.where(p > 0, p, 1))), _CELLS - 1), _CELLS).astype(np.int64)

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        s = shared.value
        if not len(a):
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())], ["cell", "weight", "pair", "ch", "cw"])
        h, w, pair, ch, cw, _, one = _bucket_counts(s, a, b)
        h, w, pair, ch, cw = h[one], w[one], pair[one], ch[one], cw[one]
        cell = (_bucket(ch - 1) * (_CELLS + 1) + grid((pair - 1) / np.maximum(ch - 1, 1))) * (_CELLS + 1) + grid((cw - 1) / max(s.total - 1, 1))
        order, starts = _groups(cell)
        weight = np.add.reduceat(pair[order], starts)
        hot = np.flatnonzero(pair * HOT > s.total)
        none = [None] * len(starts)
        return pa.table(
            [
                pa.array([*cell[order][starts].tolist(), *[None] * len(hot)], pa.int64()), pa.array([*weight.tolist(), *pair[hot].tolist()], pa.int64()),
                pa.array([*none, *_pair(h[hot], w[hot]).view(np.int64).tolist()], pa.int64()), pa.array([*none, *ch[hot].tolist()], pa.int64()), pa.array([*none, *cw[hot].tolist()], pa.int64()),
            ],
            ["cell", "weight", "pair", "ch", "cw"],
        )

    return sent.groupBy("bucket").cogroup(told.groupBy("bucket")).applyInArrow(run, "cell long, weight long, pair long, ch long, cw long")


def estimate(cells: np.ndarray, weight: np.ndarray, kinds: int) -> np.ndarray:
    """(context buckets, 3) weights of no, word and bigram context, from summed deleted counts."""
    p1, p2 = cells % (_CELLS + 1), cells // (_CELLS + 1) % (_CELLS + 1)
    b = cells // (_CELLS + 1) ** 2
    p = np.stack([np.full(len(cells), 1.0 / (kinds + 1)), *(np.where(x < _CELLS, 2.0 ** (-x / GRID), 0.0) for x in (p1, p2))], axis=1)
    a = np.full((CONTEXTS, 3), 1 / 3)
    a[0] = [0.5, 0.5, 0]  # a context never seen has no bigrams
    for _ in range(ROUNDS):
        share = a[b] * p
        share *= (weight / np.maximum(share.sum(axis=1), 1e-300))[:, None]
        sums = np.stack([np.bincount(b, share[:, j], CONTEXTS) for j in range(3)], axis=1)
        total = sums.sum(axis=1, keepdims=True)
        a = np.where(total > 0, np.maximum(sums / np.maximum(total, 1e-300), [1e-4, 1e-4, 0]), a)
        a /= a.sum(axis=1, keepdims=True)
    return a


def released(spark: SparkSession) -> None:
    """Let Spark drop shuffle files that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def score(df: DataFrame, key: str = "doc_id", text: str = "text", is_train=None) -> DataFrame:
    """(id, train, n_tokens, n_known, train_tokens, base_score, score) of every row; scores are log10 probabilities of whole texts.

    ``is_train`` is a boolean column: the rows that teach. ``base_score`` is that
    of add-one unigrams.

    Defined cases: a null or empty text is the end alone; a null id is an id; rows
    that repeat an id are rows of their own; with no training rows every
    probability is 1 / (V + 1) = 1; an empty table gives no rows; other columns are
    ignored, whatever their names.
    """
    spark = df.sparkSession
    small_batches(spark)
    docs = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"), F.coalesce(is_train, F.lit(False)).alias("train"))
    size, lessons = docs.agg(F.sum(F.octet_length("text")), F.count_if("train")).first()
    buckets = max(24, (size or 0) // BUCKET_BYTES)
    counts = saved(word_counts(docs, buckets))
    total, kinds = counts.agg(F.sum("total"), F.sum("kinds")).first()
    known, n = frequent(counts, FREQUENT)
    for extra, c in ((BEGIN, lessons), (END, lessons)):  # each text has one of either
        if extra not in known:
            at = np.searchsorted(known, extra)
            known, n = np.insert(known, at, extra), np.insert(n, at, c)
    state = _Shared(known, n, total or 0, kinds or 0, buckets)
    shared = spark.sparkContext.broadcast(state)
    told = saved(answers(docs, counts, shared, buckets, train_only=False))
    sums = deleted_counts(send(docs, shared, scoring=False), told, shared)
    got = sums.groupBy("cell", "pair", "ch", "cw").agg(F.sum("weight").alias("weight")).collect()  # at most a grid of cells and HOT bigrams
    cells = [r for r in got if r["cell"] is not None]
    weights = estimate(np.array([r["cell"] for r in cells], np.int64), np.array([r["weight"] for r in cells], float), state.kinds)
    hot = sorted((r["pair"] & (1 << 64) - 1, r["weight"], r["ch"], r["cw"]) for r in got if r["cell"] is None)
    state.hot = np.array([r[0] for r in hot], np.uint64)
    state.hot_log = state.log10(weights, *(np.array([r[i] for r in hot], np.int64) for i in (1, 2, 3)))
    shared = spark.sparkContext.broadcast(state)
    del sums, got
    released(spark)

    part = "batch long, kind int, " + ", ".join(f"{c} binary" for c in "abcdef")

    def sum_up(a: pa.Table, b: pa.Table) -> pa.Table:
        s = shared.value
        out = []
        if len(a):
            kind = a["kind"].to_numpy()
            for r in a.filter(pa.array(kind == 1)).to_pylist():
                out.append((r["batch"], 1, *(r[c] for c in ("h", "w", "tail", "train", "times", "docs"))))
            a = a.filter(pa.array(kind == 0))
        if len(a):
            _, w, pair, ch, cw, lens, _ = _bucket_counts(s, a, b)
            logs = s.log10(weights, pair, ch, cw)
            far = w >= _TAIL
            base = np.where(far, np.log10((cw + 1) / (s.total + s.kinds + 1)), 0.0)
            at = 0
            for batch, times, docs_, m in zip(a["batch"].to_pylist(), a["times"].to_pylist(), a["docs"].to_pylist(), lens, strict=True):
                t, d = _from_planes(times), np.frombuffer(docs_, np.uint16)
                sl = slice(at, at + m)
                at += m
                each = np.repeat(np.arange(m), t)
                some = np.unique(d)
                where = np.searchsorted(some, d)
                tail = far[sl][each]
                rare = np.unique(d[tail])
                of = np.searchsorted(rare, d[tail])
                out.append((
                    batch, 0, some.tobytes(), np.bincount(where, logs[sl][each], len(some)).tobytes(), rare.tobytes(),
                    np.bincount(of, base[sl][each][tail], len(rare)).tobytes(), np.bincount(of, (cw[sl] > 0)[each][tail], len(rare)).tobytes(), b"",
                ))
        return pa.table([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int32(), *[pa.binary()] * 6))], ["batch", "kind", *"abcdef"])

    def finish(t: pa.Table) -> pa.Table:
        rows = sorted(t.to_pylist(), key=lambda r: -r["kind"])
        ids = np.frombuffer(rows[0]["a"], np.int64)
        n_tokens, known_, base, logs = (np.frombuffer(rows[0][c], np.float64).copy() for c in "bcde")
        flags = np.frombuffer(rows[0]["f"], np.uint8).reshape(2, -1).astype(bool)
        for r in sorted(rows[1:], key=lambda r: (r["a"], r["b"])):  # in one order, so that sums agree from run to run
            np.add.at(logs, np.frombuffer(r["a"], np.uint16), np.frombuffer(r["b"], np.float64))
            rare = np.frombuffer(r["c"], np.uint16)
            np.add.at(base, rare, np.frombuffer(r["d"], np.float64))
            np.add.at(known_, rare, np.frombuffer(r["e"], np.float64))
        return pa.table(
            [pa.array(ids, mask=flags[1]), pa.array(flags[0]), pa.array(n_tokens.astype(np.int64)), pa.array(known_.astype(np.int64)), pa.array(base), pa.array(logs)],
            ["id", "train", "n_tokens", "n_known", "base_score", "score"],
        )

    sums = send(docs, shared, scoring=True).groupBy("bucket").cogroup(told.groupBy("bucket")).applyInArrow(sum_up, part)
    done = sums.groupBy("batch").applyInArrow(finish, "id long, train boolean, n_tokens long, n_known long, base_score double, score double")
    return done.select(F.col("id").alias(key), "train", "n_tokens", "n_known", F.lit(state.total).cast("long").alias("train_tokens"), "base_score", "score")


def op4(spark, sf_dir: str) -> DataFrame:
    from docfacts.llm.common import read

    docs = read(spark, sf_dir, "documents")
    done = score(docs, is_train=remainder(F.col("doc_id"), 7) != 2)
    return done.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")

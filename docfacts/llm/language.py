"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for each piece of a fixed public vocabulary. A
word's probability is the sum over all its segmentations into pieces of the
product of their probabilities, by the forward algorithm; a text's is the
product over its words. The pieces' probabilities come from expected counts
(forward-backward) over training words, in a few rounds of expectation-
maximisation from equal probabilities.

Fitting uses at most ``FIT_DOCS`` training documents of each language, those with
the smallest hashes; language shares are counted over all training documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from docfacts.llm import vocabulary
from docfacts.llm.common import GAP, remainder, saved
from docfacts.llm.vocabulary import PieceTable
from docfacts.llm.wordhash import pieces

#: Training documents of a language that the probabilities are fitted on, at most; rounds of fitting.
FIT_DOCS, ROUNDS = 600, 3
#: Code points of a word (with its leading mark) up to which words of one length are done together; a longer word is walked from end to end.
WORD_CHARS = 24
#: Code points of long words that are looked up together.
BLOCK_CHARS = 1 << 15
#: Pseudo-count of each piece; share of a character that is no piece among all unknown characters.
PRIOR, UNKNOWN_SHARE = 0.02, 1e-4
#: Words whose scores a task keeps.
KEPT_WORDS = 1 << 19


@dataclass
class Model:
    langs: list[str]
    shares: np.ndarray  # log share of each language
    table: PieceTable
    probs: np.ndarray  # (pieces + 1, languages); the last is a character that is no piece


def parted(words: list[str]) -> tuple[list[str], np.ndarray, list[str], np.ndarray]:
    """Words with their leading mark, and which word each is of: those of at most WORD_CHARS code points, then longer ones by length."""
    marked = [vocabulary.SPACE + w for w in words]
    short = [i for i, w in enumerate(marked) if len(w) <= WORD_CHARS]
    long = sorted((i for i, w in enumerate(marked) if len(w) > WORD_CHARS), key=lambda i: len(marked[i]))
    return [marked[i] for i in short], np.array(short, np.int64), [marked[i] for i in long], np.array(long, np.int64)


def by_length(strings: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(indices, code points) of strings of one length at a time, some thousands together."""
    lens = np.array([len(s) for s in strings])
    order = np.argsort(lens, kind="stable")
    edges = np.flatnonzero(np.diff(lens[order], prepend=-1))
    for a, b in zip(edges, np.append(edges[1:], len(order)), strict=True):
        for lo in range(a, b, 4096):
            at = order[lo : min(b, lo + 4096)]
            n = int(lens[at[0]])
            yield at, np.frombuffer("".join(strings[i] for i in at).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(at), n)


def forward(table: PieceTable, probs: np.ndarray, points: np.ndarray, found=None) -> np.ndarray:
    """(positions + 1, words, languages): the summed probability of all segmentations up to each position."""
    found = table.substrings(points) if found is None else found
    n = points.shape[1]
    alpha = np.zeros((n + 1, len(points), probs.shape[1]))
    alpha[0] = 1
    for end in range(1, n + 1):
        for start in range(max(0, end - table.longest), end):
            place = found[start, end]
            if end - start == 1:
                alpha[end] += alpha[start] * probs[place]  # -1 is the unknown character
            else:
                some = np.flatnonzero(place >= 0)
                if len(some):
                    alpha[end][some] += alpha[start][some] * probs[place[some]]
    return alpha


def _padded(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of strings, a row each, and their numbers."""
    lens = np.array([len(s) for s in strings])
    points = np.zeros((len(strings), lens.max()), np.uint32)
    for i, s in enumerate(strings):
        points[i, : lens[i]] = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, lens


def walk(table: PieceTable, probs: np.ndarray, points: np.ndarray, lens: np.ndarray, back: bool = False) -> Iterator[tuple[int, np.ndarray]]:
    """Long words from their first code point to their last, in logs: (end, (words, languages)) for each end.

    That is the log of the summed probability of all segmentations up to there. Only
    the sums of the last ``longest`` positions are held, relative to the newest, so a
    word's length is bounded by nothing. With ``back`` rows are read from their last
    code point to their first (all must be of one length): (start, sums from there on).
    """
    n, w, longest = points.shape[1], len(points), table.longest
    none = len(probs)
    padded = np.vstack([probs, np.zeros((1, probs.shape[1]))])
    ring = np.zeros((longest, w, probs.shape[1]))  # by distance
    ring[0] = 1
    log = np.zeros((w, probs.shape[1]))
    step = max(longest, BLOCK_CHARS // w)
    for lo in range(0, n, step):
        hi = min(n, lo + step)
        a, b = (max(0, n - hi), n - lo) if back else (max(0, lo + 1 - longest), hi)
        places = table.spans(points, lens, a, b)
        places[0] = np.where((places[0] < 0) & (np.arange(a, b) < lens[:, None]), none - 1, places[0])  # the unknown character
        places = np.where(places < 0, none, places)
        for at in range(lo + 1, hi + 1):  # code points done, from either side
            if back:
                which = places[:, :, n - at - a]
            else:
                which = np.full((longest, w), none)
                size = np.arange(1, min(longest, at) + 1)
                which[size - 1] = places[size - 1, :, at - size - a]
            new = (ring * padded[which]).sum(axis=0)
            live = new > 0  # false behind a word's end
            scale = np.where(live, new, 1.0)
            ring[1:] = np.minimum(ring[:-1] / scale, 1e300)
            ring[0] = 1
            log += np.log(scale)
            yield n - at if back else at, log


def long_batches(strings: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of strings, sorted by length, that are walked together."""
    a = 0
    for b in range(1, len(strings) + 1):
        if b == len(strings) or (b + 1 - a) * len(strings[b]) > BLOCK_CHARS or len(strings[b]) > 2 * len(strings[a]):
            yield a, b
            a = b


def log_probs(model: Model, words: list[str]) -> np.ndarray:
    """(words, languages): the log of the summed probability of all segmentations of each word."""
    out = np.zeros((len(words), len(model.langs)))
    short, of, long, of_long = parted(words)
    for at, points in by_length(short):
        out[of[at]] = np.log(forward(model.table, model.probs, points)[-1])
    for a, b in long_batches(long):
        points, lens = _padded(long[a:b])
        for end, log in walk(model.table, model.probs, points, lens):
            if end >= lens[0]:
                done = np.flatnonzero(lens == end)
                out[of_long[a + done]] = log[done]
    return out


def _expected(table: PieceTable, probs: np.ndarray, words: list[str], counts: np.ndarray) -> np.ndarray:
    """Expected uses of each piece over all segmentations of the words (one language: probs has one column)."""
    total = np.zeros(len(probs))
    short, of, long, of_long = parted(words)
    for at, points in by_length(short):
        n, found = points.shape[1], table.substrings(points)
        alpha = forward(table, probs, points, found)[:, :, 0]
        beta = np.zeros_like(alpha)
        beta[n] = 1
        for start in range(n - 1, -1, -1):
            for end in range(start + 1, min(n, start + table.longest) + 1):
                place = found[start, end]
                p = probs[place, 0] if end - start == 1 else np.where(place >= 0, probs[place, 0], 0)
                beta[start] += p * beta[end]
        weight = counts[of[at]] / alpha[n]
        for (start, end), place in found.items():
            some = np.flatnonzero(place >= 0) if end - start > 1 else np.arange(len(place))
            if len(some):
                p = place[some]
                use = alpha[start][some] * probs[p, 0] * beta[end][some] * weight[some]
                total += np.bincount(np.where(p < 0, len(probs) - 1, p), use, len(probs))
    for word, count in zip(long, counts[of_long], strict=True):  # in logs, from both sides
        points, lens = _padded([word])
        n = len(word)
        ahead, behind = np.zeros(n + 1), np.zeros(n + 1)
        for end, log in walk(table, probs, points, lens):
            ahead[end] = log[0, 0]
        for start, log in walk(table, probs, points, lens, back=True):
            behind[start] = log[0, 0]
        for lo in range(0, n, BLOCK_CHARS):
            places = table.spans(points, lens, lo, min(n, lo + BLOCK_CHARS))[:, 0]
            for size in range(1, table.longest + 1):
                start = np.arange(lo, lo + places.shape[1])[: max(0, n - size + 1 - lo)]
                p = places[size - 1][: len(start)]
                if size == 1:
                    p = np.where(p < 0, len(probs) - 1, p)
                start, p = start[p >= 0], p[p >= 0]
                total += np.bincount(p, count * np.exp(ahead[start] + np.log(probs[p, 0]) + behind[start + size] - ahead[n]), len(probs))
    return total


def fit(train: DataFrame, path: str = vocabulary.DEFAULT) -> Model | None:
    """``train`` (id, text, lang) to a model; None if it has no language."""
    spark = train.sparkSession
    able = train.filter("text is not null and lang is not null")
    shares = sorted((r["lang"], r["n"]) for r in able.groupBy("lang").agg(F.count("*").alias("n")).collect())  # a row per language
    if not shares:
        return None
    langs = [lang for lang, _ in shares]
    span = 1 << 30
    sampled = [(F.col("lang") == lang) & (F.pmod(F.xxhash64("id", "text"), F.lit(span)) < int(span * min(1.0, FIT_DOCS / n))) for lang, n in shares]
    chosen = sampled[0]
    for s in sampled[1:]:
        chosen = chosen | s
    words = saved(
        able.filter(chosen).select("lang", F.explode(F.split("text", GAP)).alias("word")).filter("word <> ''").groupBy("lang", "word").agg(F.count("*").alias("n"))
    )
    table = PieceTable([p for _, p, _ in vocabulary.load(path)])
    n = int((table.values >= 0).sum()) + 1
    probs = np.full((n, len(langs)), 1.0 / n)
    for _ in range(ROUNDS):
        shared = spark.sparkContext.broadcast((table, probs))

        def expect(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            tab, p = shared.value
            sums = np.zeros((len(p), len(langs)))
            for batch in batches:
                lang, word, count = (batch.column(i).to_pylist() for i in range(3))
                for j, name in enumerate(langs):
                    mine = [i for i, x in enumerate(lang) if x == name]
                    if mine:
                        sums[:, j] += _expected(tab, p[:, j : j + 1], [word[i] for i in mine], np.array([count[i] for i in mine], float))
            at = np.flatnonzero(sums.ravel())
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(sums.ravel()[at])], ["at", "use"])

        used = words.repartition(32, "word").mapInArrow(expect, "at long, use double").groupBy("at").agg(F.sum("use").alias("use")).collect()  # at most pieces x languages
        sums = np.full(n * len(langs), PRIOR)
        for r in used:
            sums[r["at"]] += r["use"]
        sums = sums.reshape(n, len(langs))
        probs = sums / sums.sum(axis=0)
        probs[-1] *= UNKNOWN_SHARE
    total = sum(c for _, c in shares)
    return Model(langs, np.log([c / total for _, c in shares]), table, probs)


def _hashed(rest: Iterator, known: np.ndarray, most: int = 16) -> Iterator[tuple]:
    """Of the next pieces of text: (first row, hashes and strings of words that aren't known, hashes of all words, words of each row, their start)."""
    for _, (a, _, words) in zip(range(most), rest):  # noqa: B905  the rest is longer
        h = words.hashes()
        keys, first = np.unique(h, return_index=True)
        if len(known):
            new = known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] != keys
            keys, first = keys[new], first[new]
        raw = words.data.tobytes()
        yield a, keys, [raw[s:e] for s, e in zip(words.start[first].tolist(), words.end[first].tolist(), strict=True)], h, words.counts, words.first[:-1]


def predicted(df: DataFrame, model: Model | None, text: str = "text") -> Column:
    """A struct (lang, score) from a text column: the likeliest language and its posterior probability; ('und', 0) without a letter."""
    col = F.col(text)
    nothing = F.struct(F.lit("und").alias("lang"), F.lit(0.0).alias("score"))
    if model is None:
        return nothing
    shared = df.sparkSession.sparkContext.broadcast(model)

    @arrow_udf("lang string, score double")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        known, logs = np.zeros(0, np.uint64), np.zeros((0, len(m.langs)))
        for texts in batches:
            total = np.zeros((len(texts), len(m.langs))) + m.shares
            rest = pieces(texts, lower=False)
            while some := list(_hashed(rest, known)):
                keys, first = np.unique(np.concatenate([p[1] for p in some]), return_index=True)
                strings = [s for p in some for s in p[2]]
                if len(keys):
                    fresh = log_probs(m, [strings[i].decode() for i in first])
                    place = np.searchsorted(known, keys)
                    known, logs = np.insert(known, place, keys), np.insert(logs, place, fresh, axis=0)
                for a, _, _, h, counts, firsts in some:
                    filled = np.flatnonzero(counts)
                    if len(filled):
                        total[a + filled] += np.add.reduceat(logs[np.searchsorted(known, h)], firsts[filled])
                if len(known) > KEPT_WORDS:
                    known, logs = known[:0], logs[:0]
            best = total.argmax(axis=1) if len(total) else np.zeros(0, np.int64)
            score = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1) if len(total) else np.zeros(0)
            yield pa.StructArray.from_arrays([pa.array([m.langs[i] for i in best], pa.string()), pa.array(score)], names=["lang", "score"])

    return F.when(F.coalesce(col.rlike(r"\p{L}"), F.lit(False)), predict(col)).otherwise(nothing)


def identify(df: DataFrame, train: DataFrame, key: str = "doc_id", text: str = "text", path: str = vocabulary.DEFAULT) -> DataFrame:
    """(id, lang_pred, score) of each row, from the languages of ``train`` (id, text, lang).

    Defined cases: a null text, or one without a letter, is 'und' with score 0,
    and so is every text if nothing can be learned; a null id is an id; ties go to
    the language that sorts first; other columns are ignored, whatever their names.
    """
    rows = df.select(F.col(key).alias("id"), F.col(text).alias("text"))
    return rows.select(F.col("id").alias(key), predicted(rows, fit(train, path)).alias("p")).select(key, F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


def op7(spark, sf_dir: str) -> DataFrame:
    from docfacts.llm.common import read

    docs = read(spark, sf_dir, "documents")
    held_out = remainder(F.col("doc_id"), 4) == 2
    train = docs.filter(~held_out).select(F.col("doc_id").alias("id"), "text", "lang")
    return identify(docs, train).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")

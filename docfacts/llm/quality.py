"""Quality classifier: a sparse ensemble of rules (Friedman and Popescu, 2008).

1. Statistics of each whole text: lengths, shares of kinds of bytes, repetition.
2. Small trees are boosted on a sample of labelled rows; every path from a root to
   a node is a rule, a conjunction of bounds on statistics.
3. Lasso logistic regression weighs the rules; most weights become zero. The
   penalty is chosen on a part of the sample that the trees did not see.
4. The rules that are left become one Spark column expression.

The fit takes at most ``FIT_ROWS`` labelled rows, those with the smallest hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from docfacts.llm.common import remainder, small_batches
from docfacts.llm.wordhash import pieces

#: Labelled rows that the rules are fitted on, at most.
FIT_ROWS = 12_000
TREES, DEPTH, RATE, CUTS = 40, 3, 0.3, 24
STATS = (
    "log_words", "log_bytes", "mean_word", "long_words", "short_words", "upper", "digits", "stops", "marks", "beyond_ascii",
    "marked_words", "bare_marks", "capital_words", "lines", "distinct_words", "top_word", "repeated_lines",
)

_KIND = np.zeros(256, np.uint8)  # 1 upper, 2 lower, 3 digit, 4 . , ; : ' ? -, 5 other marks, 6 beyond ASCII
_KIND[0x41:0x5B], _KIND[0x61:0x7B], _KIND[0x30:0x3A], _KIND[0x80:] = 1, 2, 3, 6
_KIND[[c for c in range(0x21, 0x7F) if not chr(c).isalnum()]] = 5
_KIND[[ord(c) for c in ".,;:'?-\"()"]] = 4


def _per_row(words, values: np.ndarray) -> np.ndarray:
    return np.bincount(words.doc, values, words.rows)


def measure(words) -> np.ndarray:
    """(rows, STATS) of some texts; shares of an empty text are 0."""
    rows, n = words.rows, words.counts
    size = np.diff(words.offsets)
    cum = np.zeros((7, len(words.data) + 1), np.int64)
    kinds = _KIND[words.data]
    for kind in range(1, 7):
        np.cumsum(kinds == kind, out=cum[kind, 1:])
    per_row = cum[:, words.offsets[1:]] - cum[:, words.offsets[:-1]]
    per_word = cum[:, words.end] - cum[:, words.start]
    lens = words.end - words.start
    letters = per_word[1] + per_word[2] + per_word[6]
    newlines = np.concatenate(([0], np.cumsum(words.data == 0x0A)))
    lines = newlines[words.offsets[1:]] - newlines[words.offsets[:-1]] + (size > 0)
    h = words.hashes()
    distinct, top = np.zeros(rows), np.zeros(rows)
    for r in np.flatnonzero(n):
        own = np.sort(h[words.first[r] : words.first[r + 1]])
        edges = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1], [True])))
        distinct[r], top[r] = len(edges) - 1, np.diff(edges).max()
    # A line is named by the sum of its words' hashes, weighted by place.
    repeated = np.zeros(rows)
    if len(h):
        line = newlines[words.start] + words.doc  # a new text starts a new line, too
        starts = np.flatnonzero(np.concatenate(([True], (line[1:] != line[:-1]) | (words.doc[1:] != words.doc[:-1]))))
        place = np.arange(len(h)) - np.repeat(starts, np.diff(np.append(starts, len(h))))
        name = np.add.reduceat(h * (place.astype(np.uint64) * np.uint64(2) + np.uint64(1)), starts)
        of = words.doc[starts]
        order = np.lexsort((name, of))
        same = (name[order][1:] == name[order][:-1]) & (of[order][1:] == of[order][:-1])
        repeated = np.bincount(of[order][1:][same], minlength=rows).astype(float)
    words_, bytes_ = np.maximum(n, 1), np.maximum(size, 1)
    return np.stack(
        [
            np.log1p(n), np.log1p(size), _per_row(words, lens) / words_, _per_row(words, lens > 12) / words_, _per_row(words, lens < 3) / words_,
            per_row[1] / bytes_, per_row[3] / bytes_, per_row[4] / bytes_, per_row[5] / bytes_, per_row[6] / bytes_,
            _per_row(words, per_word[5] > 0) / words_, _per_row(words, letters + per_word[3] == 0) / words_,
            _per_row(words, (per_word[1] > 1) & (per_word[2] == 0)) / words_, lines / words_, distinct / words_, top / words_, repeated / np.maximum(lines, 1),
        ],
        axis=1,
    )


@arrow_udf(T.StructType([T.StructField(s, T.DoubleType()) for s in STATS]))
def statistics(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The statistics of each text; a null text counts as empty."""
    for texts in batches:
        parts = [measure(words) for _, _, words in pieces(texts, lower=False)]
        table = np.concatenate(parts) if parts else np.zeros((0, len(STATS)))
        yield pa.StructArray.from_arrays([pa.array(table[:, i]) for i in range(len(STATS))], names=list(STATS))


#: A rule: (statistic, is it an upper bound, bound) for each of its conditions.
Rule = tuple[tuple[str, bool, float], ...]


@dataclass
class Ensemble:
    rules: list[Rule]
    weights: list[float]
    intercept: float

    def column(self, stats: str) -> Column:
        """The score as a column expression over the struct column ``stats``."""
        total = F.lit(self.intercept)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            holds = F.lit(True)
            for name, upper, bound in rule:
                x = F.col(f"{stats}.{name}")
                holds = holds & ((x <= bound) if upper else (x > bound))
            total = total + F.when(holds, weight).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def _fires(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for name, upper, bound in rule:
        v = x[:, STATS.index(name)]
        out &= (v <= bound) if upper else (v > bound)
    return out


def _grow(x, residual, rows, path, depth, cuts, rng, rules, out) -> None:
    """Split rows where the squared error falls most; note each node's path and set its mean."""
    out[rows] = residual[rows].mean()
    if depth == 0 or len(rows) < 20:
        return
    best = (1e-9, None)
    total, n = residual[rows].sum(), len(rows)
    for f in rng.choice(len(STATS), max(4, len(STATS) * 2 // 3), replace=False):
        v = x[rows, f]
        order = np.argsort(v, kind="stable")
        running = np.cumsum(residual[rows][order])
        at = np.searchsorted(v[order], cuts[f], "right")
        ok = (at >= 5) & (at <= n - 5)
        if ok.any():
            left = running[at[ok] - 1]
            gain = left**2 / at[ok] + (total - left) ** 2 / (n - at[ok]) - total**2 / n
            i = int(gain.argmax())
            if gain[i] > best[0]:
                best = (gain[i], (int(f), float(cuts[f][ok][i])))
    if best[1] is None:
        return
    f, bound = best[1]
    left = x[rows, f] <= bound
    for side, upper in ((rows[left], True), (rows[~left], False)):
        step = (*path, (STATS[f], upper, bound))
        rules.append(step)
        _grow(x, residual, side, step, depth - 1, cuts, rng, rules, out)


def _lasso(z: np.ndarray, y: np.ndarray, penalty: float, w: np.ndarray, b: float, steps: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression with an absolute penalty, by accelerated proximal gradient steps."""
    rate = 4.0 / max(np.linalg.norm(z.T @ z, 2) / len(z) + 1, 1e-9)
    v, vb, t = w.copy(), b, 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(z @ v + vb)))
        new = v - rate * (z.T @ (p - y)) / len(z)
        new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
        new_b = vb - rate * (p - y).mean()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = new + (t - 1) / t2 * (new - w), new_b + (t - 1) / t2 * (new_b - b)
        w, b, t = new, new_b, t2
    return w, b


def fit_rules(x: np.ndarray, y: np.ndarray) -> Ensemble:
    """An ensemble from statistics and labels (0 or 1), in a stated order; without both labels a constant."""
    share = (y.sum() + 1) / (len(y) + 2)
    if len(np.unique(y)) < 2:
        return Ensemble([], [], float(np.log(share / (1 - share))))
    rng = np.random.default_rng(8)
    check = rng.random(len(y)) < 0.2
    grow = np.flatnonzero(~check)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0.02, 0.98, CUTS))) for f in range(x.shape[1])]
    score, rules = np.full(len(y), np.log(share / (1 - share))), []
    for _ in range(TREES):
        residual = y - 1 / (1 + np.exp(-score))
        rows = np.sort(rng.choice(grow, max(1, int(len(grow) * 0.6)), replace=False))
        step, found = np.zeros(len(y)), []
        _grow(x, residual, rows, (), DEPTH, cuts, rng, found, step)
        for rule in found:  # a node's mean holds for all rows that reach it
            fires = _fires(rule, x)
            inside = fires[rows]
            if inside.any():
                step[fires] = residual[rows][inside].mean()
        score += RATE * 4 * step
        rules += found
    rules = list(dict.fromkeys(rules))
    z = np.stack([_fires(r, x) for r in rules], axis=1).astype(float)
    mean, spread = z[grow].mean(axis=0), z[grow].std(axis=0)
    use = spread > 0.02
    rules, z, mean, spread = [r for r, u in zip(rules, use, strict=True) if u], z[:, use], mean[use], spread[use]
    if not rules:
        return Ensemble([], [], float(np.log(share / (1 - share))))
    z = (z - mean) / spread
    w, b = np.zeros(len(rules)), float(np.log(share / (1 - share)))
    best = (np.inf, w, b)
    most = np.abs(z[grow].T @ (y[grow] - y[grow].mean())).max() / len(grow)
    for penalty in most * np.geomspace(0.5, 0.005, 8):
        w, b = _lasso(z[grow], y[grow], penalty, w, b)
        p = np.clip(1 / (1 + np.exp(-(z[check] @ w + b))), 1e-9, 1 - 1e-9)
        loss = -(y[check] * np.log(p) + (1 - y[check]) * np.log(1 - p)).mean() if check.any() else 0.0
        if loss < best[0]:
            best = (loss, w.copy(), b)
    _, w, b = best
    kept = np.flatnonzero(w)
    return Ensemble([rules[i] for i in kept], [float(w[i] / spread[i]) for i in kept], float(b - (w * mean / spread).sum()))


def fit(docs: DataFrame, labels: DataFrame) -> Ensemble:
    """``docs`` (id, text) and ``labels`` (id, label 0 or 1; other labels teach nothing; the smallest of a repeated id counts, in labels and in statistics), of at most FIT_ROWS ids."""
    small_batches(docs.sparkSession)
    able = labels.filter("id is not null and label in (0, 1)").groupBy("id").agg(F.min("label").alias("label"))
    n = able.count()
    span = 1 << 30
    about = able.filter(F.pmod(F.xxhash64("id"), F.lit(span)) < int(span * min(1.0, FIT_ROWS / max(n, 1))))
    sample = F.broadcast(about.orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS))
    found = docs.join(sample, "id").select("id", "label", statistics("text").alias("s")).groupBy("id", "label").agg(F.min("s").alias("s"))  # an id teaches once
    rows = found.select("id", "label", "s.*").collect()
    rows.sort(key=tuple)
    x = np.array([r[2:] for r in rows], float).reshape(len(rows), len(STATS))
    return fit_rules(x, np.array([r[1] for r in rows], float))


def score(df: DataFrame, model: Ensemble, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, score) of every row.

    Defined cases: a null text is empty, an empty text has the score of its
    statistics, which are 0; a null id is an id; without labels the score is the
    constant 0.5; an empty table gives no rows; other columns are ignored.
    """
    rows = df.select(F.col(key).alias("_id"), statistics(F.col(text)).alias("_stats"))
    return rows.select(F.col("_id").alias(key), model.column("_stats").alias("score"))


def op8(spark, sf_dir: str) -> DataFrame:
    from docfacts.llm.common import read

    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    held_out = remainder(F.col("doc_id"), 5) == 0
    known = labels.filter(~held_out).select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    model = fit(docs.filter(~held_out).select(F.col("doc_id").alias("id"), "text"), known)
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))

import math
import random
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from docfacts.llm import language
from docfacts.llm.vocabulary import PieceTable


def slow(word, probs, unknown):
    """Sum over all segmentations, by recursion."""
    if not word:
        return 1.0
    total = 0.0
    for n in range(1, len(word) + 1):
        p = probs.get(word[:n], unknown if n == 1 else 0.0)
        total += p * slow(word[n:], probs, unknown) if p else 0.0
    return total


def test_forward_sums_all_segmentations():
    pieces = ["▁", "a", "b", "ab", "ba", "▁a", "bab"]
    table = PieceTable(pieces)
    p = np.array([0.1, 0.2, 0.15, 0.1, 0.05, 0.2, 0.1, 0.01])
    model = language.Model(["x"], np.zeros(1), table, p[:, None])
    probs = dict(zip(pieces, p))
    words = ["ab", "babab", "c", "abcba", ""]
    got = language.log_probs(model, words)[:, 0]
    for w, g in zip(words, got):
        assert math.isclose(g, math.log(slow("▁" + w, probs, 0.01)), rel_tol=1e-9)


def model_of(pieces, p, langs=1):
    return language.Model([str(i) for i in range(langs)], np.zeros(langs), PieceTable(pieces), np.array(p)[:, None] ** np.arange(1, langs + 1))


def exact_sums(word, probs, unknown):
    """Sums over all segmentations up to each position, in exact fractions."""
    sums = [Fraction(1)]
    for end in range(1, len(word) + 1):
        total = Fraction(0)
        for n in range(1, end + 1):
            p = probs.get(word[end - n : end], unknown if n == 1 else 0.0)
            total += Fraction(p) * sums[end - n]
        sums.append(total)
    return sums


def log_of(x):
    return math.log(x.numerator) - math.log(x.denominator)


def test_long_words_are_whole(monkeypatch):
    monkeypatch.setattr(language, "BLOCK_CHARS", 50)  # several blocks
    pieces = ["▁", "a", "b", "ab", "ba", "▁a", "bab", "aaaabbbb"]
    p = [0.1, 0.2, 0.15, 0.1, 0.05, 0.2, 0.1, 0.08, 1e-9]
    model = model_of(pieces, p, langs=2)
    rng = random.Random(1)
    words = ["".join(rng.choice("aabbc") for _ in range(n)) for n in (22, 23, 24, 25, 60, 100, 101, 333)] + ["c" * 400, "ab" * 300]
    got = language.log_probs(model, words)
    for w, g in zip(words, got):
        for i in range(2):
            want = exact_sums("▁" + w, dict(zip(pieces, model.probs[:, i])), model.probs[-1, i])[-1]
            assert math.isclose(g[i], log_of(want), rel_tol=1e-9)


def test_expected_counts_against_exact_sums():
    pieces = ["▁", "a", "b", "ab", "ba", "▁a", "bab"]
    p = [0.1, 0.2, 0.15, 0.1, 0.05, 0.2, 0.1, 0.01]
    words, counts = ["ab", "babab", "c", "abcba" * 3, "abbac" * 12, "ba" * 40], np.array([1.0, 2, 3, 1, 2, 4])
    got = language._expected(PieceTable(pieces), np.array(p)[:, None], words, counts)
    probs, want = dict(zip(pieces, p)), [Fraction(0)] * len(p)
    for w, n in zip(words, counts):
        w = "▁" + w
        ahead = exact_sums(w, probs, p[-1])
        behind = exact_sums(w[::-1], {k[::-1]: v for k, v in probs.items()}, p[-1])[::-1]
        for start in range(len(w)):
            for end in range(start + 1, len(w) + 1):
                piece = w[start:end]
                at = pieces.index(piece) if piece in probs else len(p) - 1 if end - start == 1 else None
                if at is not None:
                    want[at] += int(n) * ahead[start] * Fraction(p[at]) * behind[end] / ahead[-1]
    assert np.allclose(got, [float(x) for x in want], rtol=1e-9)


def test_query_on_held_out_documents(spark, sf, documents):
    rows = language.op7(spark, sf).join(documents.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == documents.count()
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_edges(edge, nothing):
    train = edge.select(F.col("doc_id").alias("id"), "text", "lang")
    rows = {r["doc_id"]: r for r in language.identify(edge, train).collect()}
    assert {rows[i]["lang_pred"] for i in (2, 3, 4, 12)} == {"und"} and rows[3]["score"] == 0
    assert rows[5]["lang_pred"] in ("en", "fr") and rows[None]["lang_pred"] in ("en", "fr") and rows[11]["lang_pred"] == "en"
    assert language.identify(nothing, train).count() == 0
    blind = language.identify(edge, nothing.select(F.col("doc_id").alias("id"), "text", "lang")).collect()
    assert {r["lang_pred"] for r in blind} == {"und"}

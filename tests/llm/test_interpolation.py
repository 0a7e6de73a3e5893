import math
import zlib
from collections import Counter

import pytest
from frames import edge_rows
from pyspark.sql import functions as F

from docfacts.llm import interpolation


def brute(rows, train, weights):
    """(n_tokens, n_known, N, base, score) of each (id, text)."""
    seqs = [(t or "").encode().lower().split() + [0] for _, t in rows]
    c, pairs, before = Counter(), Counter(), Counter()
    for s, teach in zip(seqs, train):
        for h, w in zip([1, *s], s):
            if teach:
                c[w] += 1
                pairs[h, w] += 1
                before[h] += 1
    n, v = sum(c.values()), len(c)
    for s in seqs:
        base = score = known = 0
        for h, w in zip([1, *s], s):
            a = weights[min(int(math.log2(before[h])) + 1, interpolation.CONTEXTS - 1) if before[h] else 0]
            base += math.log10((c[w] + 1) / (n + v + 1))
            score += math.log10(a[2] * pairs[h, w] / max(before[h], 1) + a[1] * c[w] / max(n, 1) + a[0] / (v + 1))
            known += c[w] > 0
        yield len(s), known, n, base, score


def keep_weights(monkeypatch):
    got, real = {}, interpolation.estimate
    monkeypatch.setattr(interpolation, "estimate", lambda *a: got.setdefault("w", real(*a)))
    return got


@pytest.mark.parametrize("few", [False, True])
def test_query_against_brute_force(spark, sf, documents, monkeypatch, few):
    if few:  # uncommon words, hot bigrams, many batches and buckets
        for name, v in (("FREQUENT", 400), ("HOT", 100), ("BATCH_TOKENS", 5000), ("BUCKET_BYTES", 20000)):
            monkeypatch.setattr(interpolation, name, v)
    got = keep_weights(monkeypatch)
    rows = {r["doc_id"]: r for r in interpolation.op4(spark, sf).collect()}
    docs = [(r["doc_id"], r["text"]) for r in documents.collect()]
    train = [zlib.crc32(str(i).encode()) % 7 != 2 for i, _ in docs]
    for (i, _), teach, want in zip(docs, train, brute(docs, train, got["w"])):
        r = rows[i]
        assert r["held_out"] == (not teach) and (r["n_tokens"], r["n_known"], r["train_tokens"]) == want[:3]
        assert r["base_score"] == pytest.approx(want[3], rel=1e-9) and r["score"] == pytest.approx(want[4], rel=1e-6)
    held = [r for r in rows.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_edges(edge, nothing, monkeypatch):
    got = keep_weights(monkeypatch)
    rows = interpolation.score(edge, is_train=F.col("doc_id") < 9).collect()
    data = [(r[0], r[1]) for r in edge_rows()]
    want = list(brute(data, [i is not None and i < 9 for i, _ in data], got["w"]))
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 4)) for r in rows) == sorted((str(i), n, k, round(b, 4)) for (i, _), (n, k, _, b, _) in zip(data, want))
    assert interpolation.score(nothing, is_train=F.lit(True)).count() == 0
    blind = interpolation.score(edge, is_train=F.lit(False)).collect()
    assert len(blind) == 14 and all(r["base_score"] == 0 and r["n_known"] == 0 for r in blind)

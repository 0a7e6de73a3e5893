import hashlib
from collections import Counter

import numpy as np
from frames import edge_rows

from docfacts.llm import fingerprints


def jaccard(a, b):
    a, b = Counter(a.encode().split()), Counter(b.encode().split())
    most = sum(max(a[k], b[k]) for k in a.keys() | b.keys())
    return sum(min(a[k], b[k]) for k in a.keys() & b.keys()) / most if most else 1.0


def test_query_estimates_generalised_jaccard(spark, sf, documents):
    rows = {r["doc_id"]: r for r in fingerprints.op5(spark, sf).collect()}
    docs = [(r["doc_id"], r["text"] or "") for r in documents.orderBy("doc_id").collect()]
    near, nxt, prints = [], [], {}
    for n, (i, t) in enumerate(docs):
        after = docs[(n + 1) % len(docs)][1]
        cut = len(t) // 4
        edited = t[: len(t) - cut] + after[:cut]
        r = rows[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert prints.setdefault(t, r["fingerprint"]) == r["fingerprint"]
        near.append(r["near_edited"] - jaccard(t, edited))
        nxt.append(r["near_next"] - jaccard(t, after))
    assert abs(np.mean(near)) < 0.02 and abs(np.mean(nxt)) < 0.01
    assert np.std(near) < 0.13


def test_edges(edge, nothing):
    rows = {}
    for r in fingerprints.fingerprints(edge).collect():
        rows.setdefault(r["doc_id"], []).append(r)
    assert len(rows[8]) == 2 and sum(map(len, rows.values())) == 14
    assert set(rows[3][0]["sig"]) == {-1} and set(rows[4][0]["sig"]) == {-1} and rows[2][0]["n_chars"] == 0
    assert rows[6][0]["sig"] == rows[8][0]["sig"]
    assert rows[12][0]["next"] == rows[None][0]["sig"]  # after the last comes the first, the null id
    assert rows[11][0]["n_chars"] == 5000
    assert fingerprints.fingerprints(nothing).count() == 0
    assert edge_rows()[0][0] == 1

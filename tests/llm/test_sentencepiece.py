import numpy as np
import pytest
from frames import edge_rows

from docfacts.llm import sentencepiece, vocabulary

class Slow:
    def __init__(self):
        pieces = vocabulary.load()
        self.best = {p.replace("▁", " "): (s, i) for i, p, s in pieces}
        self.bytes = vocabulary.byte_ids()
        self.unknown = min(s for _, _, s in pieces if s > -1e8) - sentencepiece.UNKNOWN_COST

    def path(self, unit):
        at = [(0.0, 0, [])]
        for e in range(1, len(unit) + 1):
            ways = []
            for s in range(max(0, e - 16), e):
                p = unit[s:e]
                if p in self.best:
                    ways.append((at[s][0] + self.best[p][0], -s, [self.best[p][1]]))
                elif e - s == 1:
                    ways.append((at[s][0] + self.unknown, -s, [self.bytes[b] for b in p.encode()]))
            at.append(max(ways, key=lambda w: w[:2]))
        ids, e = [], len(unit)
        while e:
            ids, e = at[e][2] + ids, -at[e][1]
        return ids

    def encode(self, text):
        """The best path of the whole text, without any cut."""
        return self.path(" " + text)


@pytest.fixture(scope="module")
def slow():
    return Slow()


@pytest.mark.parametrize("most", [6_000_000, 300])
def test_query_against_a_plain_search(spark, documents, slow, most):
    rows = {r["doc_id"]: r for r in sentencepiece.encode(documents, most=most).collect()}
    for r in documents.collect():
        assert rows[r["doc_id"]]["ids"] == slow.encode(r["text"]) and rows[r["doc_id"]]["exact"]


def test_units_that_share_a_hash_are_walked(spark, documents, monkeypatch):
    want = {r["doc_id"]: r["ids"] for r in sentencepiece.encode(documents).collect()}

    def some(units):
        return np.sort(np.array([r["h"] for r in units.orderBy("h").limit(200).collect()], np.int64).view(np.uint64))

    monkeypatch.setattr(sentencepiece, "shared_hashes", some)
    for most in (6_000_000, 300):
        got = sentencepiece.encode(documents, most=most).collect()
        assert {r["doc_id"]: r["ids"] for r in got} == want and all(r["exact"] for r in got)


def test_edges_and_round_trip(spark, edge, nothing, slow):
    coded = sentencepiece.encode(edge)
    decode = sentencepiece.decoder(spark)
    got = sorted((str(r[0]), r[1], r[2]) for r in coded.select("doc_id", "ids", decode("ids")).collect())
    want = sorted((str(r[0]), None if r[1] is None else slow.encode(r[1]), r[1]) for r in edge_rows())
    assert [g[:2] for g in got] == [w[:2] for w in want] and [g[2] for g in got] == [w[2] for w in want]
    assert sentencepiece.encode(nothing).count() == 0

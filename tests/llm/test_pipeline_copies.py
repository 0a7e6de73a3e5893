"""Copies among rows that repeat an id or have none."""

import corpus_pipeline
from frames import CLASH, NEAR, frame


def test_copies_are_decided_by_row(spark):
    other = " ".join(f"other{i}" for i in range(60))
    third = " ".join(f"third{i}" for i in range(60))
    rows = [(3, NEAR), (5, NEAR), (5, other), (None, NEAR + " tail"), (None, third), (None, third), (None, third + " tail"), (7, None), (7, None), (None, None), (2, "")]
    docs = frame(spark, [(i, t, "en", "a", None) for i, t in rows], clash=False)
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_copies(spark, docs, "").collect()]
    of_third = [g for g in got if (g[1] or "").startswith("third")]
    assert len(of_third) == 1 and of_third[0][0] is None
    assert sorted(map(str, [g for g in got if g not in of_third])) == sorted(map(str, [(3, NEAR), (5, other), (7, None), (None, None), (2, "")]))

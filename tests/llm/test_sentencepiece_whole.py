"""Pieces against a plain search over whole texts, without any cuts."""

import pytest
from frames import frame
from test_sentencepiece import Slow

from docfacts.llm import sentencepiece

TEXTS = [
    "He left.” Then", "he said,” and «so», or «not». It’s “it’.” …] (†", "        if x:\n\n    \t  y = 1  ", "a;\r b();\r\n});\r\r\n c", "x" * 5000, "ab" * 40 + "." * 90 + " " * 100 + "end",
    "internationalisation" * 12, "吾輩は猫である。名前はまだ無い。" * 9, "https://example.com/aVeryLong/Path-with_" + "q8Zk" * 30, "\U0001f600" * 30 + "é" * 50, "", " ", "\r", " " * 17,
]


@pytest.mark.parametrize("most", [6_000_000, 5])
def test_pieces_of_whole_texts(spark, most):
    slow = Slow()
    rows = sentencepiece.encode(frame(spark, [(i, t, "en", "a", len(t)) for i, t in enumerate(TEXTS)]), most=most).collect()
    assert {r["doc_id"]: (r["ids"], r["exact"]) for r in rows} == {i: (slow.path(" " + t), True) for i, t in enumerate(TEXTS)}


def test_documents_whole(spark, documents):
    slow = Slow()
    rows = {r["doc_id"]: r["ids"] for r in sentencepiece.encode(documents).collect()}
    for r in documents.collect():
        assert rows[r["doc_id"]] == slow.path(" " + r["text"])

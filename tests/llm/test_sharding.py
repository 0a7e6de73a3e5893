import zlib
from collections import Counter

import xxhash

from docfacts.llm import sharding


def slow_jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def test_query_is_jump_hashing_of_every_document(spark, sf, documents):
    rows = sharding.op1(spark, sf).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in documents.collect()}
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        key = xxhash.xxh64(r["doc_id"].to_bytes(8, "little", signed=True), seed=42).intdigest()
        assert r["shard"] == slow_jump(key, 8) and r["grown_shard"] == slow_jump(key, 9)
        assert r["grown_shard"] in (r["shard"], 8)
        raw = texts[r["doc_id"]].encode()
        assert r["size"] == len(raw) + 1 and r["text_crc32"] == zlib.crc32(raw) and r["law"] == "key"
    for shard, n in Counter(r["shard"] for r in rows).items():
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(n))


def test_edges(edge, nothing):
    rows = sharding.assign(edge, "doc_id", 3).collect()
    assert len(rows) == 14
    assert len({r["shard"] for r in rows if r["doc_id"] == 8}) == 1
    assert sorted(r["slot"] for r in rows if r["shard"] == rows[0]["shard"]) == list(range(sum(r["shard"] == rows[0]["shard"] for r in rows)))
    assert sharding.assign(nothing, "doc_id", 3).count() == 0

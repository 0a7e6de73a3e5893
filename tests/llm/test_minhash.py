import random

import numpy as np
from frames import edge_rows, frame

from docfacts.llm import minhash
from docfacts.llm.components import components


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k, percent):
    """(id, size, component) by comparing all sets."""
    sets = [(i, shingles(t, k)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return sorted((i, len(s), find(i)) for i, s in sets)


def run(df, k, percent=80):
    return sorted(tuple(r) for r in minhash.near_duplicates(df, shingle=k, percent=percent).collect() if r[0] is not None)


def test_copies_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(minhash, "TILE", 8)  # several tiles
    rng = random.Random(3)
    rows = []
    for g in range(12):
        base = [f"w{rng.randrange(3000)}" for _ in range(120)]
        rows.append(base)
        for _ in range(rng.randrange(1, 40)):
            copy = list(base if rng.random() < 0.7 else rng.choice(rows[-3:]))
            for _ in range(rng.choice([0, 1, 1, 2, 3, 4, 6, 9])):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(3000)}"
            rows.append(copy)
    rng.shuffle(rows)
    data = [(i, " ".join(w), "en", "s", 0) for i, w in enumerate(rows)]
    assert run(frame(spark, data), 4) == brute([(i, t) for i, t, *_ in data], 4, 80)


def test_edges(spark, edge, nothing):
    found = run(edge, 4)
    assert found == brute([(i, t) for i, t, *_ in edge_rows()], 4, 80)
    assert dict((i, c) for i, _, c in found)[8] == 6
    assert minhash.near_duplicates(nothing).count() == 0
    null = [r for r in minhash.near_duplicates(edge).collect() if r["doc_id"] is None]
    assert len(null) == 1 and null[0]["component_id"] is None


def test_estimate_is_unbiased():
    rng = np.random.default_rng(5)
    off = []
    for _ in range(60):
        common, own = rng.integers(0, 2**63, 300, dtype=np.uint64), rng.integers(0, 2**63, (2, 60), dtype=np.uint64)
        sets = [np.unique(np.concatenate((common, o))) for o in own]
        a, b = (minhash.pack(minhash.minima(s, np.array([0])))[0] for s in sets)
        d = a ^ b
        d |= d >> np.uint64(1)
        d |= d >> np.uint64(2)
        differ = int(np.bitwise_count(d & np.uint64(0x1111111111111111)).sum())
        off.append((1 - differ / 128 - 1 / 16) / (1 - 1 / 16) - 300 / 420)
    assert abs(np.mean(off)) < 0.02


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert all(got[i] == 0 for i in range(61)) and all(got[i] == 100 for i in range(100, 140))


def test_template_pages_below_the_threshold(spark, monkeypatch):
    """Pages of one template, 0.7 alike, meet in buckets without links; what the meetings hand on stays linear."""
    rng = random.Random(11)
    template = [f"t{i}" for i in range(140)]
    rows = [(i, " ".join(template + [f"p{i}x{j}" for j in range(26 + rng.randrange(3))]), "en", "s", 0) for i in range(1000)]
    rows += [(1000 + i, f"{rows[7 * i][1]} more", "en", "s", 0) for i in range(20)]
    seen = []
    made = minhash._meetings
    monkeypatch.setattr(minhash, "_meetings", lambda *a: seen.append(made(*a).count()) or made(*a))
    found = dict((i, c) for i, _, c in run(frame(spark, rows), 4))
    assert found == {i: i if i < 1000 else 7 * (i - 1000) for i in range(1020)}
    assert 1000 < seen[0] < 32 * 1020 * 4  # some pair for each member, bucket and tile at most; all pairs would be half a million a bucket


def test_components(spark, monkeypatch):
    from docfacts.llm import components as module

    rng = random.Random(5)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(None, 3), (5, None), (900, 900)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    df = spark.createDataFrame(edges, "a long, b long")
    for few in (1 << 14, 40, 0):  # in one task, after some rounds, by rounds alone
        monkeypatch.setattr(module, "FEW_EDGES", few)
        assert {r["id"]: r["component"] for r in components(df).collect()} == {x: find(x) for x in root}
    assert components(df.limit(0)).count() == 0

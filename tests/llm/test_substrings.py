import random
from collections import Counter

from frames import edge_rows, frame

from docfacts.llm import common, substrings


def brute(texts, window):
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone |= set(range(i, i + window))
        out.append((len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return out


def check(spark, rows, window):
    got = sorted(map(repr, ((r[0], r[1], r[2], r[3]) for r in substrings.remove_repeats(frame(spark, rows), window=window).collect())))
    want = sorted(repr((r[0], n, m, None if r[1] is None else k)) for r, (n, m, k) in zip(rows, brute([r[1] for r in rows], window)))
    assert got == want


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(substrings, "BATCH_WINDOWS", 300)
    rng = random.Random(2)
    passages = [[f"p{rng.randrange(500)}" for _ in range(n)] for n in (12, 20, 36, 60)]
    rows = []
    for i in range(120):
        words = [f"w{rng.randrange(60)}" for _ in range(rng.randrange(0, 120))]
        for _ in range(rng.randrange(0, 3)):
            at = rng.randrange(len(words) + 1)
            words[at:at] = rng.choice(passages)
        rows.append((i, " ".join(words), "en", "s", 0))
    for window in (12, 35, 2):
        check(spark, rows, window)


def test_edges(spark, nothing):
    check(spark, edge_rows(), 35)
    check(spark, [(1, "a " * 100, None, None, None), (2, "a a b", None, None, None)], 3)
    assert substrings.remove_repeats(nothing).count() == 0


def test_cleaned_keeps_columns_and_other_texts(spark, edge):
    done = substrings.cleaned(edge, window=35)
    assert done.columns == edge.columns
    rows = {r["doc_id"]: r["text"] for r in done.collect()}
    assert rows[1] == edge_rows()[0][1] and rows[6] == "" and rows[2] is None and rows[4] == " \t\n "


def test_tasks_follow_the_texts(spark, tmp_path, monkeypatch):
    """The result has a task a core for little text, however many partitions a shuffle has, and more for more text."""
    session = spark.newSession()
    session.conf.set("spark.sql.shuffle.partitions", "40")
    session.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    session.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    rows = [(i, f"{i} " * (i % 50) + "same words " * (i % 3) * 20, "en", "s", 0) for i in range(400)]
    frame(session, rows).write.parquet(f"{tmp_path}/in")

    def files(make, name):
        make(session.read.parquet(f"{tmp_path}/in")).write.parquet(f"{tmp_path}/{name}")
        return len(list((tmp_path / name).glob("part-*")))

    cores = spark.sparkContext.defaultParallelism
    assert files(substrings.remove_repeats, "few") <= cores and files(substrings.cleaned, "cleaned") <= cores
    monkeypatch.setattr(common, "TASK_BYTES", 1)
    assert files(substrings.remove_repeats, "many") > cores
    got = [sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in spark.read.parquet(f"{tmp_path}/{name}").collect()) for name in ("few", "many")]
    assert got[0] == got[1] == sorted((i, n, m, k) for (i, *_), (n, m, k) in zip(rows, brute([r[1] for r in rows], 35), strict=True))

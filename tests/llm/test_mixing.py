from docfacts.llm import mixing


def test_targets_and_takings(spark, sf):
    rows = mixing.op10(spark, sf).collect()
    by = {}
    for r in rows:
        by.setdefault((r["source_size"], r["target"]), []).append(r)
        assert r["taken"] in (0, r["size"], 2 * r["size"])
    total = sum(r["size"] for r in rows)
    assert abs(sum(t for _, t in by) - 1.5 * total) < 1e-6 * total
    for (size, target), group in by.items():
        assert target <= 2 * size + 1e-6
        assert abs(sum(r["taken"] for r in group) - target) <= max(r["size"] for r in group)


def test_positions_are_sorted_and_match_copies(spark, sf, documents):
    planned = mixing.schedule(documents)
    found = mixing.positions(planned).orderBy("position").collect()
    assert [r["position"] for r in found] == list(range(len(found)))
    order = [(r["time"], r["doc_id"], r["copy"]) for r in found]
    assert order == sorted(order) and all(0 <= t <= 1 for t, _, _ in order)
    assert len(found) == planned.agg({"copies": "sum"}).first()[0]
    again = mixing.positions(mixing.schedule(documents.repartition(5))).orderBy("position").collect()
    assert [(r["time"], r["doc_id"], r["copy"]) for r in again] == order  # reruns agree


def test_every_lap_is_read(spark, documents):
    planned = mixing.schedule(documents, share=2.6, limit=3.0)
    rows = planned.collect()
    assert max(r["copies"] for r in rows) == 3 and all(r["copies"] == len(r["times"]) and r["taken"] == r["copies"] * r["size"] for r in rows)
    copies = sum(r["copies"] for r in rows)
    assert mixing.positions(planned).count() == copies
    mixed = [r["doc_id"] for r in mixing.mixed(documents, share=2.6, limit=3.0).collect()]
    assert mixed == [r["doc_id"] for r in mixing.positions(planned).orderBy("position").collect()]


def test_edges(edge, nothing):
    rows = {}
    for r in mixing.schedule(edge).collect():
        rows.setdefault(r["doc_id"], []).append(r)
    assert rows[2][0]["size"] == 0 and rows[3][0]["taken"] == 0 and rows[4][0]["size"] == 0
    assert len(rows[8]) == 2 and rows[8][0]["size"] == 200
    assert rows[None][0]["source"] is None
    assert mixing.schedule(nothing).count() == 0
    mixed = mixing.mixed(edge)
    assert mixed.columns == edge.columns and mixed.filter("text is null").count() == 0
    assert mixing.mixed(nothing).count() == 0 and mixing.positions(mixing.schedule(nothing)).count() == 0

import datetime
import json
import xml.etree.ElementTree as ET
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from docfacts.operators import dedupe, items, listing, profiles, provenance, staging
from docfacts.sources import landing, sinks
from docfacts.streaming import pipelines


def fields(spark, **values):
    base = {n: None for n in provenance.FIELDS} | values
    row = spark.range(1).select(*[provenance.field(F.lit(v).cast("string"), 70, "ocr", "m", "e").alias(n) for n, v in base.items()])
    return provenance.with_amounts(row)


GOOD = {"proveedor_cuit": "30-50001091-2", "tipo_comprobante": "FACTURA_A", "punto_venta": "0001", "numero_comprobante": "00000001", "fecha_emision": "2024-01-01", "total": "1210.00", "neto_gravado": "1000.00", "iva_21": "210.00"}


def test_validation(spark):
    ok = fields(spark, **GOOD).select(provenance.failures().alias("f"), provenance.balance().alias("b")).first()
    assert ok["f"] == [] and ok["b"]["ok"] and ok["b"]["calculado"] == D("1210.00")
    bad = fields(spark, **GOOD | {"proveedor_cuit": "30-50001091-3", "iva_21": "100.00", "fecha_emision": ""}).select(provenance.failures().alias("f")).first()["f"]
    assert {(x["codigo"], x["campo"]) for x in bad} == {("INVALID_CUIT", "proveedor_cuit"), ("TOTAL_MISMATCH", "total"), ("MISSING_CRITICAL_FIELD", "fecha_emision")}
    none = fields(spark).select(provenance.balance().alias("b"), provenance.missing_names().alias("m")).first()
    assert none["b"]["ok"] and len(none["m"]) == 6


def test_one_tax_under_two_labels(spark):
    rows = fields(spark, **GOOD | {"total": "1240.00", "otros_tributos": "30.00", "percepciones_iibb": "30.00"})
    got = rows.withColumns(provenance.resolve_double_tax()).select("otros_tributos.valor", F.col("percepciones_iibb.valor").alias("p")).first()
    assert tuple(got) == (None, "30.00")
    rows = fields(spark, **GOOD | {"total": "1240.00", "otros_tributos": "30.00", "percepciones_iibb": "900.00"})
    got = rows.withColumns(provenance.resolve_double_tax()).select("otros_tributos.valor", "percepciones_iibb").first()
    assert got[0] is None and got[1]["valor"] == "30.00" and got[1]["confianza"] == 80


def test_vat_total_sanity_and_advice(spark):
    assert fields(spark, iva_21="10.00", iva_27="5.50").select(provenance.vat_total().alias("v")).first()["v"]["valor"] == "15.50"

    def sane(a, total, cuit, refs):
        d = "decimal(18,2)"
        return spark.range(1).select(provenance.sane_perception(F.lit(a).cast(d), F.lit(total).cast(d), F.lit(cuit), [F.lit(r).cast(d) for r in refs])).first()[0]

    assert sane("30", "100", "", ["50"]) == 30 and sane("300", "100", "", ["50"]) == 0 and sane("60", "100", "", ["50"]) == 0
    assert sane("1000000", "0", "", ["0"]) == 0 and sane("30500010912", "0", "30-50001091-2", ["0"]) == 0
    advice = spark.createDataFrame([(True, True, "x"), (False, True, " "), (False, True, "x"), (False, False, "x")], "d boolean, r boolean, b string")
    assert [r[0] for r in advice.select(provenance.recommendation(F.col("d"), F.col("r"), F.col("b"))).collect()] == ["ignorar_duplicado", "reintentar", "revisar_manualmente", "aceptar"]


def test_profiles(spark, tmp_path):
    path = tmp_path / "p.json"
    path.write_text(json.dumps({"proveedores": {"30": {"nombre": "N", "aliases": ["Acme"], "campos": {"total": ["A pagar"]}}}, "aliases_globales": {"Acme Group": "30"}}))
    d = profiles.load(spark, str(path))
    assert profiles.suppliers(d).first()["profile"]["aliases"] == ["Acme"] and profiles.global_aliases(d).first()["tax_id"] == "30"

    def pick(body, qr="", tx="", aliases=(), own=()):
        return tuple(spark.range(1).select(profiles.select_profile(F.lit(body), F.lit(qr), F.lit(tx), list(aliases), list(own), ["30", "31"]).alias("p")).first()["p"])

    both = [("uno", "30"), ("dos", "30")]
    assert pick("x", qr="3-0") == ("qr_cuit", "30") and pick("x", tx="31") == ("text_cuit", "31")
    assert pick("El Uno", aliases=both) == ("alias", "30") and pick("uno dos", aliases=both) == ("alias_ambiguo", None)
    assert pick("uno dos", own=both) == ("alias", "30") and pick("uno dos", own=[("uno", "30"), ("dos", "31")]) == ("alias_ambiguo", None) and pick("x") == ("sin_perfil", None)


def test_upsert_and_overlay(spark):
    old = spark.createDataFrame([(1, "a", 5, 7), (2, "b", 9, 7), (None, "n", 1, 7)], "k int, v string, used int, prio int")
    new = spark.createDataFrame([(1, "A", 3, 50, 0), (3, "C", 4, 50, 0), (None, "N", 2, 50, 0)], "k int, v string, used int, prio int, other int")
    got = {tuple(r) for r in staging.upsert(old, new, ["k"], keep=("prio",), greatest=("used",)).collect()}
    assert got == {(1, "A", 5, 7), (2, "b", 9, 7), (3, "C", 4, 50), (None, "N", 2, 7)}
    changed = staging.overlay(old, spark.createDataFrame([(2, "z")], "k int, v string"), "k")
    assert {r["v"] for r in changed.collect()} == {"a", "z", "n"} and changed.columns == old.columns
    assert staging.latest(old.withColumn("g", F.lit(1)), ["g"], [F.desc("used")]).first()["k"] == 2
    assert staging.align(new, ["v", "zz"]).columns == ["v"] and "zz" in staging.ensure_column(old, "zz", "int").columns


def test_duplicates(spark):
    t = datetime.datetime(2024, 1, 1)
    hours = lambda h: t + datetime.timedelta(hours=h)
    rows = spark.createDataFrame([(1, "k", hours(0)), (2, "k", hours(72)), (3, "k", hours(144)), (4, "k", hours(217)), (5, "j", hours(1))], "id int, k string, ts timestamp")
    got = {r["id"]: r["is_repeat"] for r in dedupe.ttl_repeats(rows, ["k"], "ts", 72, ["id"]).collect()}
    assert got == {1: False, 2: True, 3: True, 4: False, 5: False}
    bits = spark.createDataFrame([(1, 0b1111), (2, 0b0111), (3, 0b0000), (4, 0b1111)], "id int, b long")
    assert {tuple(r) for r in dedupe.hash_pairs(bits, "id", F.col("b"), 16, 1).collect()} == {(1, 2, 1), (1, 4, 0), (2, 4, 1)}
    days = [(1, [7, 0], 0), (2, [7, 1], 10), (3, [3, 1], 20), (4, [7, 1], 200), (5, None, 201)]
    seen = spark.createDataFrame(days, "id int, b array<long>, h int").withColumn("ts", F.timestamp_add("HOUR", F.col("h"), F.lit(datetime.datetime(2024, 1, 1))))
    near = dedupe.ttl_near(seen, "id", [F.get("b", F.lit(i)) for i in (0, 1)], 32, 1, "ts", 72)
    assert {r["id"]: r["near_of"] for r in near.collect()} == {1: None, 2: 1, 3: 2, 4: None, 5: None}


def test_lookup(spark):
    from docfacts.operators import lookup

    parties = spark.createDataFrame([(3, "c", "ACME SRL", None), (1, None, "Acme Group", "x"), (2, "c", None, "Ñandú"), (None, "d", "Nadie", "")], "party int, code string, name1 string, name2 string")
    docs = spark.createDataFrame([(1, "c", ""), (2, "z", "acme"), (3, None, "ñan"), (4, "z", "me sr"), (5, "z", "acmegroup"), (6, "z", None), (7, "", "X"), (8, "d", "nadie")], "id int, code string, name string")
    got = {r["id"]: (r["party"], r["how"]) for r in lookup.two_tier(docs, parties, ["name1", "name2"]).collect()}
    assert got == {1: (2, "id"), 2: (1, "name"), 3: (2, "name"), 4: (3, "name"), 5: (None, "none"), 6: (None, "none"), 7: (1, "name"), 8: (None, "none")}


def test_listing(spark):
    assert [listing.clamp(x) for x in (None, "x", 0, 7, 999)] == [50, 50, 1, 7, 200]
    rows = spark.createDataFrame([(f"f{i:03d}",) for i in range(50)], "path string")
    got = {r["path"]: r["id"] for r in listing.with_position(rows, "path").collect()}
    assert all(got[f"f{i:03d}"] == 50 - i for i in range(50))
    twice = spark.createDataFrame([("b", 1), (None, 2), ("a", 3), ("b", 4), (None, 5)], "path string, n int")
    found = listing.with_position(twice, "path").collect()
    assert sorted(r["id"] for r in found) == [1, 2, 3, 4, 5] and {r["n"]: (r["id"] + 1) // 2 if r["n"] in (1, 4) else r["id"] for r in found if r["path"]} == {1: 1, 4: 1, 3: 3}
    assert {r["id"] for r in found if r["path"] is None} == {4, 5} and listing.with_position(twice.limit(0), "path").count() == 0
    with pytest.raises(ValueError):
        listing.by_prefix(rows, "path", "xyz")
    m = spark.range(1).select(listing.redacted(F.create_map(F.lit("API_KEY"), F.lit("v"), F.lit("n"), F.lit("v"))).alias("m")).first()["m"]
    assert m == {"API_KEY": "***", "n": "v"}


def test_item_layouts():
    def rows(*lines):
        return [tuple(x.values()) for x in items.items_of("\n".join(lines))]

    head = ("FACTURA A", "Producto / Servicio", "Cantidad", "Subtotal")
    assert rows(*head, "Servicio de enero", "2026", "3", "kg", "21 %", "1.000,50", "3.001,50", "Otro", "1", "5,00", "Subtotal: 1,00", "Nada", "1") == [
        ("Servicio de enero", D(3), D("1000.50"), D("3001.50")), ("Otro", D(1), D("5.00"), D("5.00")),
    ]
    assert rows(*head, "Subtotal c/IVA", "Pieza", "2", "kg", "10,00", "20,00", "24,20") == [("Pieza", D(2), D("10.00"), D("20.00"))]
    assert rows("Detalle", "2,00", "Motor electrico", "150000", "300000", "4", "Tornillos", "1", "TOTAL", "CAE 1") == [("Motor electrico", D(2), D(1500), D(3000)), ("Tornillos", D(4), None, None)]
    assert rows("Detalle", "2,00 Tuerca M8 100,00 20000", "Total: 1") == [("Tuerca M8", D(2), D(100), D(20000))]
    assert rows("Detalle", "12 UN Bomba de agua 3,00", "modelo nuevo 100,00 300,00", "con garantia", "Total: 1") == [("Bomba de agua modelo nuevo con garantia", D(3), D(100), D(300))]
    assert rows("ACME", "Aceite de girasol 12 100,50 1.206,00", "Total 1") == [("Aceite de girasol", D(12), D("100.50"), D(1206))]
    assert rows("Detalle") == [] and rows("Detalle", "CAE") == [] and rows("Detalle", "5") == []
    assert rows("Detalle", "Pieza", "9" * 30, "kg", "1,123456789", "2") == [("Pieza", None, D("1.1235"), D(2))]


def test_items_cleaned(spark):
    found = [("Total", D(1), D(1), D(1)), ("2 Flete a Salta 1.000,00 0,00 2.000,00 Exento", None, None, None), ("Aceite 2,00 unidades 10,00 0,00 20,00 21% 24,20", None, None, None),
             ("Pieza", D(1), D(1), D(50)), ("", None, None, None), (None, None, None, D(3)), ("Totalmente nuevo", None, None, None)]
    df = spark.createDataFrame([(1, found), (2, None), (3, [])], f"i int, f {items.ITEM.simpleString()}")
    got = {r["i"]: r["f"] and [tuple(x) for x in r["f"]] for r in df.select("i", items.cleaned(F.col("f")).alias("f")).collect()}
    assert got == {1: [("Flete a Salta", D(2), D(1000), D(2000)), ("Aceite", D(2), D(10), D(20)), ("Pieza", D(1), D(50), D(50)), (None, None, None, D(3)), ("Totalmente nuevo", None, None, None)], 2: None, 3: []}


def test_items_and_perceptions(spark):
    body = "FACTURA A\nCantidad  Descripción  Precio  Subtotal\nTornillo largo  2  1.000,00  2.000,00\nde acero\nIVA  1  1,00  1,00\nSubtotal: 2.000,00\nOtra  1  1,00  1,00"
    assert items.items_of(body) == [{"descripcion": "Tornillo largo de acero", "cantidad": D(2), "precio_unitario": D("1000.00"), "subtotal": D("2000.00")}]
    assert items.items_of(None) == [] and items.items_of("nada") == []
    text = "Ingresos Brutos: 30-50001091-2\nPercepción IIBB Misiones\n$ 1.230,50\nPercepción IIBB Misiones 230,50\nPercepciones Ingresos Brutos Córdoba: 45,00"

    def found(*bodies):
        rows = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, c string").select("i", items.perceptions(F.col("c")).alias("p")).orderBy("i").collect()
        return [[(p["jurisdiccion"], p["codjur"], p["importe"]) for p in r["p"]] for r in rows]

    misiones = [("MISIONES", "914", D("1230.50"))]
    assert found(text, None, "") == [[*misiones, ("CORDOBA", "904", D("45.00"))], [], []]
    assert found("Percepcion IIBB Misiones\nTOTAL 999,00") == [[]]  # another field's amount
    assert found("Percepcion IIBB Misiones\nSUBTOTAL 9,00\n1.230,50\nTOTAL 7,00\n8.000,00") == [misiones]
    assert found("Percepcion IIBB Misiones 3,00\n20,00\n1.230,50", "Percepcion IIBB Misiones 60,00\n1.230,50") == [misiones, [("MISIONES", "914", D("60.00"))]]
    assert found("PERCEPCIONES\nMisiones 1.230,50", "PERCEPCIONES\n1.230,50", "IIBB Misiones RESPONSABLE 5,00") == [misiones, [], []]
    assert found("IIBB Misiones 1.230,50\nIIBB Misiones 1.230,50\nIIBB Salta 12,00\nIIBB Salta 712,00") == [[*misiones, ("SALTA", "0", D("712.00"))]]


def test_page_layout(spark):
    rows = [(1, 0, 10.0, 100.0, 30.0, "Total"), (1, 0, 80.0, 101.0, 99.0, "5"), (1, 0, 32.0, 102.0, 40.0, "a"), (1, 0, 10.0, 200.0, 20.0, "fin")]
    got = items.page_texts(spark.createDataFrame(rows, "doc long, page int, x0 double, y0 double, x1 double, text string")).first()["text"]
    assert got == "Total a  5\nfin"
    rows = [(1, 0, 50.0, 10.0, 60.0, "b"), (1, 0, 10.0, 13.0, 20.0, "a"), (1, 0, 90.0, 15.0, 99.0, "c"), (1, 0, 200.0, 18.0, 210.0, "next"), (1, 0, 10.0, 99.0, 20.0, " "), (2, 3, 1.0, 1.0, 2.0, "x")]
    pages = items.page_texts(spark.createDataFrame(rows, "doc long, page int, x0 double, y0 double, x1 double, text string")).collect()
    assert {(r["doc"], r["page"]): r["text"] for r in pages} == {(1, 0): "a  b  c\nnext", (2, 3): "x"}


def test_sources(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"x")
    (tmp_path / "b.txt").write_bytes(b"y")
    got = landing.files(spark, str(tmp_path)).collect()
    assert [r["filename"] for r in got] == ["a.pdf"] and len(got[0]["sha256"]) == 64
    assert spark.createDataFrame([("=?utf-8?q?Ra=C3=BAl?= x",)], "c string").select(landing.header_text("c")).first()[0] == "Raúl x"
    s = spark.createDataFrame([("a@x.com",), ("A <b@y.com>",), ("c@z.com",), (None,)], "s string")
    assert [r[0] for r in s.select(landing.sender_allowed(F.col("s"), ["a@x.com", "@y.com"])).collect()] == [True, True, False, False]
    assert [r[0] for r in s.select(landing.sender_allowed(F.col("s"), ["z.com"])).collect()] == [False, False, True, False]
    assert spark.range(1).select(landing.metadata({"from": F.lit("x"), "to": F.lit(" "), "cc": F.lit(None)})).first()[0] == {"from": "x"}
    both = spark.range(1).select(landing.body_of(F.lit("p"), F.lit("o")).alias("b"), landing.body_of(F.lit(""), F.lit("o")).alias("o")).first()
    assert both["b"]["engine"] == "pdf_text+ocr" and both["o"]["combined"] == "o"
    done = spark.createDataFrame([(1, True), (1, False), (2, True)], "uid int, ok boolean")
    assert [r["uid"] for r in landing.messages_done(done).collect()] == [2]
    q = spark.range(1).select(landing.reading_quality(F.lit("FACTURA A\nCUIT 30-50001091-2\nTotal 5")), landing.reading_quality(F.lit("~~~~ ^^^^ ````"))).first()
    assert q[0] > 30 > q[1]
    best = F.array(*[F.struct(F.lit(n).alias("score"), F.lit(t).alias("text")) for n, t in ((1, "a"), (5, "b"), (5, "c"))])
    assert spark.range(1).select(landing.best_reading(best)).first()[0] == "b"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, None, 2.5, [("a<b",)])], "n int, e string, f double, xs array<struct<t:string>>")
    root = ET.fromstring(df.select(sinks.document_xml(df)).first()[0])
    assert [c.tag for c in root] == ["n", "e", "f", "xs"] and root.find("f").text == "2.50" and root.find("xs/item/t").text == "a<b" and root.find("e").text is None
    sinks.write_csv([spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([(2,)], "b int")], str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).columns == ["a", "b"]
    sinks.write_json(df, str(tmp_path / "j"))
    assert (tmp_path / "j" / "_SUCCESS").exists()
    assert spark.range(1).select(sinks.file_name(F.lit("2024-01-02"), F.lit("abcdef0123"))).first()[0] == "FACTURA_20240102_abcdef01"
    assert sinks.jdbc_options(None, {}) is None and sinks.jdbc_options("mysql://h/d", {})["url"] == "jdbc:mysql://h/d"


def test_streams(spark, tmp_path):
    src, store = str(tmp_path / "in"), str(tmp_path / "store")
    spark.createDataFrame([("a", 1), ("b", 2), ("a", 1)], "sha string, v int").write.parquet(src)

    def go():
        pipelines.stage_batches(pipelines.replayed(spark, src, "sha string, v int"), lambda d: d.withColumn("w", F.col("v") * 2), store, "sha", str(tmp_path / "ck")).awaitTermination(120)
        return sorted((r["sha"], r["w"]) for r in spark.read.parquet(store).collect())

    assert go() == [("a", 2), ("b", 4)]
    spark.createDataFrame([("b", 2), ("c", 3)], "sha string, v int").write.mode("append").parquet(src)
    assert go() == [("a", 2), ("b", 4), ("c", 6)]


def test_stream_marks_repeats_as_the_batch_does(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1)
    rows = [("k", t), ("k", t + datetime.timedelta(hours=10)), ("k", t + datetime.timedelta(hours=90)), ("j", t)]
    src = str(tmp_path / "ev")
    spark.createDataFrame(rows, "k string, ts timestamp").coalesce(1).write.parquet(src)
    marked = pipelines.mark_repeats(pipelines.replayed(spark, src, "k string, ts timestamp"), "k", "ts", 72)
    q = marked.writeStream.format("memory").queryName("marked").option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r["key"], r["ts"], r["is_repeat"]) for r in spark.table("marked").collect())
    want = sorted((r["k"], r["ts"], r["is_repeat"]) for r in dedupe.ttl_repeats(spark.createDataFrame(rows, "k string, ts timestamp"), ["k"], "ts", 72, []).collect())
    assert got == want


def test_jobs(spark):
    from docfacts.operators import jobs

    at = datetime.datetime(2024, 1, 1)
    rows = [(b"x", "a.PDF", None, "mail", None, at), (b"x", "b", "image/png", "mail", False, at), (b"x", "c", "text/odd", "mail", True, at), (b"y", "d.png", None, "web", False, at), (None, "e", None, "web", True, at)]
    uploads = spark.createDataFrame(rows, "content binary, original_filename string, mime string, source_type string, force boolean, queued_at timestamp")
    first = jobs.enqueued(uploads)
    assert {(r["original_filename"], r["extension"], r["force"]) for r in first.collect()} == {("a.PDF", "pdf", False), ("c", "bin", True), ("d.png", "png", False)}
    again = jobs.enqueued(uploads, first)
    assert [r["original_filename"] for r in again.collect()] == ["c"] and jobs.enqueued(uploads.limit(0)).count() == 0
    ids_ = {r["original_filename"]: r["job_id"] for r in first.collect()}
    done = spark.createDataFrame([(ids_["d.png"], True, "no", at), (ids_["a.PDF"], False, "bad", at)], "job_id string, ok boolean, error string, finished_at timestamp").dropDuplicates(["job_id"])
    work = jobs.started(first, first.filter("force").select("job_id"), F.lit(at)).filter("status = 'PROCESSING'").collect()
    assert {r["job_id"] for r in work} == {ids_["c"]} and all(r["started_at"] == at for r in work)
    states = jobs.settled(first.filter("not force"), done)
    assert {r["original_filename"]: (r["status"], r["error"], r["folder"]) for r in states.collect()} == {"d.png": ("DONE", None, "procesados"), "a.PDF": ("ERROR", "bad", "errores")}
    assert "mime" not in jobs.summaries(states).columns and "folder" in jobs.summaries(states).columns


def test_fallback_lines(spark):
    item = "array<struct<descripcion: string, cantidad: decimal(15,4), precio_unitario: decimal(15,4), subtotal: decimal(15,2)>>"
    rows = [(1, [("x", None, None, D("5.00"))], "ACME", D("1.00"), D("2.00")), (2, [("x", None, None, None)], " ", D("0.00"), D("2.00")), (3, None, None, None, None)]
    df = spark.createDataFrame(rows, f"id int, items {item}, issuer string, net decimal(15,2), total decimal(15,2)")
    made = staging.with_fallback(F.col("items"), F.col("issuer"), F.lit(None).cast("string"), F.lit("ref"), F.col("net"), F.col("total"))
    got = {r["id"]: [(x["descripcion"], x["subtotal"]) for x in r["l"]] for r in df.select("id", made.alias("l")).collect()}
    assert got == {1: [("x", D("5.00"))], 2: [("ref", D("2.00"))], 3: [("ref", D("0.00"))]}
    ref = df.select("id", staging.reference_text(F.col("items"), F.col("items"), F.col("issuer")).alias("t"), staging.reference_amount(F.col("items"), F.col("net"), F.col("total")).alias("a")).orderBy("id").collect()
    assert [(r["t"], r["a"]) for r in ref] == [("x", D("5.00")), ("x", D("2.00")), ("", D("0.00"))]


def test_readings(spark):
    row = spark.range(1).select(
        landing.text_or_reading(F.lit("x" * 40), F.lit("y")).alias("a"), landing.text_or_reading(F.lit("x"), F.lit("y")).alias("b"), landing.text_or_reading(F.lit("x"), F.lit(" ")).alias("c"),
        landing.fetched_uid(F.lit("1 (uid  77 BODY")).alias("d"), landing.fetched_uid(F.lit(None).cast("string")).alias("e"),
    ).first()
    assert tuple(row) == ("x" * 40, "y", "x", "77", "")


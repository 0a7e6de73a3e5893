"""Extraction from rendered documents; the oracle is what they were rendered from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docfacts.functions import dates, extract, ids, numbers, payload, text
from docfacts.operators import classify, process, profiles, provenance
from docfacts.plans import render
from docfacts.plans.catalogue import query


def _sql(select: str) -> str:
    return f"WITH {render.FACTS_SQL} SELECT {select} FROM facts"


@query("extract_total", _sql("id, total AS total"))
def q_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.documents(spark, sf_dir).select("id", extract.total(F.col("body")).alias("total"))


@query("extract_total_us", _sql("id, total AS total"))
def q_total_us(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.documents(spark, sf_dir, us=True).select("id", extract.total(F.col("body")).alias("total"))


@query("extract_number", _sql("id, point, number"))
def q_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.documents(spark, sf_dir).select("id", extract.number(F.col("body")).alias("n")).select("id", "n.point", "n.number")


@query("extract_date", _sql("id, issued, issued AS expiry"))
def q_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.documents(spark, sf_dir).select("id", extract.issue_date(F.col("body")).alias("issued"), extract.expiry_date(F.col("body")).alias("expiry"))


@query("extract_letter", _sql("id, letter, 'FACTURA_' || letter AS kind, 'FACTURA' AS plain"))
def q_letter(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("body")
    return render.documents(spark, sf_dir).select("id", extract.letter(c).alias("letter"), extract.letter_kind(c).alias("kind"), extract.kind(c).alias("plain"))


@query("extract_tax_rate", _sql("id, CAST(vat AS DECIMAL(18,2)) AS vat_21, CAST(0 AS DECIMAL(18,2)) AS vat_27"))
def q_vat(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("body")
    return render.documents(spark, sf_dir).select("id", extract.vat(c, "21").alias("vat_21"), extract.vat(c, "27").alias("vat_27"))


@query("extract_net", _sql("id, net AS net, CAST(CAST(net AS DECIMAL(18,2)) AS VARCHAR) AS net_text"))
def q_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("body")
    return render.documents(spark, sf_dir).select("id", extract.net(c, F.col("total"), F.col("vat")).alias("net"), extract.net_text(c).alias("net_text"))


@query("extract_authorisation", _sql("id, lpad(CAST(id AS VARCHAR), 14, '7') AS cae, 'ARS' AS moneda"))
def q_cae(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("body")
    return render.documents(spark, sf_dir).select("id", extract.authorisation(c).alias("cae"), F.when(extract.currency(c) == "ARS", "ARS").alias("moneda"))


@query("scored_issuer_id", _sql("id, tax_id, true AS valid"))
def q_issuer(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = render.documents(spark, sf_dir).select("id", extract.issuer_tax_id(F.col("body")).alias("tax_id"))
    return rows.select("id", "tax_id", ids.valid_tax_id(ids.digits(F.col("tax_id"))).alias("valid"))


@query("business_name", _sql("id, 'Emisor' AS name, false AS bad, 'Responsable Inscripto' AS condition"))
def q_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("body")
    return render.documents(spark, sf_dir).select("id", extract.business_name(c).alias("name"), extract.bad_name(extract.business_name(c)).alias("bad"), extract.tax_condition(c).alias("condition"))


@query("evidence_lines", _sql("id, 'Importe Total: $ ' || replace(replace(replace(format('{:,.2f}', CAST(total AS DOUBLE)), ',', ';'), '.', ','), ';', '.') AS total_line, 'FACTURA ' || letter AS kind_line"))
def q_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("body")
    return render.documents(spark, sf_dir).select("id", extract.total_evidence(c).alias("total_line"), text.first_line(c, "(?iu)FACTURA").alias("kind_line"))


AMOUNTS_SQL = _sql("id, total AS from_ar, total AS from_us, total AS plain, CAST(NULL AS DECIMAL(18,2)) AS none, CAST(0 AS DECIMAL(18,2)) AS zero")


@query("amount_parse_ar_us", AMOUNTS_SQL)
def q_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = render.facts(spark, sf_dir)
    return t.select(
        "id", numbers.amount(F.concat(F.lit("ARS $ "), numbers.argentine("total"))).alias("from_ar"), numbers.amount(numbers.grouped("total")).alias("from_us"),
        numbers.amount(F.col("total").cast("string")).alias("plain"), numbers.amount(F.concat(F.lit("nada"), F.substring("issued", 1, 0))).alias("none"),
        numbers.amount_or_zero(F.concat(F.lit("-"), F.substring("issued", 1, 0))).alias("zero"),
    )


@query("date_parse", _sql("id, issued AS from_day, issued AS from_iso, strftime(CAST(issued AS DATE), '%d/%m/%Y') AS shown, CAST(NULL AS VARCHAR) AS bad"))
def q_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.to_date("issued")
    return render.facts(spark, sf_dir).select(
        "id", dates.iso_date(F.date_format(d, "d/M/yyyy")).alias("from_day"), dates.iso_date(F.concat(F.lit("el "), F.col("issued"))).alias("from_iso"), dates.any_format(F.col("issued")).alias("shown"),
        dates.iso_date(F.concat(F.lit("31/02/"), F.substring("issued", 1, 4))).alias("bad"),
    )


@query("id_checkdigit", _sql("id, tax_id, true AS good, false AS bad"))
def q_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = ids.digits(F.col("tax_id"))
    wrong = F.concat(F.substring(d, 1, 10), ((F.substring(d, 11, 1).cast("int") + 1) % 10).cast("string"))
    return render.facts(spark, sf_dir).select("id", ids.format_tax_id(d).alias("tax_id"), ids.valid_tax_id(d).alias("good"), ids.valid_tax_id(wrong).alias("bad"))


ZFILL_SQL = """
SELECT o_orderkey AS id, CASE WHEN len(k) >= 4 THEN k ELSE lpad(k, 4, '0') END AS point, CASE WHEN len(k) >= 8 THEN k ELSE lpad(k, 8, '0') END AS number,
       CASE WHEN len(k) >= 3 THEN k ELSE lpad(k, 3, '0') END AS code FROM (SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS k FROM orders)
"""


@query("zfill_codes", ZFILL_SQL)
def q_zfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("id")
    return render.facts(spark, sf_dir).select("id", ids.code_text(k, 4).alias("point"), ids.code_text(k, 8).alias("number"), ids.code_text(k, 3).alias("code"))


PAYLOAD_SQL = _sql(
    "id, issued AS fecha, replace(tax_id, '-', '') AS cuit, CAST(CAST(point AS INT) AS VARCHAR) AS point, CAST(id AS VARCHAR) AS number, CAST(total AS VARCHAR) AS importe, letter, 'FACTURA' AS kind, 'ARS' AS currency"
)


@query("payload_decode", PAYLOAD_SQL)
def q_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = render.documents(spark, sf_dir).select("id", payload.decode(F.col("url")).alias("p"))
    return p.select(
        "id", "p.fecha", "p.cuit", F.col("p.ptoVta").alias("point"), F.col("p.nroCmp").alias("number"), "p.importe", ids.letter_of_code(F.col("p.tipoCmp")).alias("letter"),
        ids.type_of_code(F.col("p.tipoCmp")).alias("kind"), ids.currency(F.col("p.moneda")).alias("currency"),
    )


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a record for each field: from the payload (every third document has none), else from the text."""
    docs = render.documents(spark, sf_dir).select("id", F.lit("").alias("pdf_text"), F.col("body").alias("ocr_text"), F.when(F.col("id") % 3 != 0, payload.decode(F.col("url"))).alias("qr"))
    return process.with_fields(docs).withColumnRenamed("ocr_text", "body")


MERGE_SQL = _sql(
    "id, tax_id AS cuit, CASE WHEN id % 3 <> 0 THEN 98 ELSE 70 END AS cuit_confidence, CASE WHEN id % 3 <> 0 THEN 'qr' ELSE 'ocr' END AS total_source, CAST(total AS VARCHAR) AS total, CAST(vat AS VARCHAR) AS vat_total, 'calculado' AS vat_source"
)


@query("provenance_merge", MERGE_SQL)
def q_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enriched(spark, sf_dir).select(
        "id", F.col("proveedor_cuit.valor").alias("cuit"), F.col("proveedor_cuit.confianza").alias("cuit_confidence"), F.col("total.fuente").alias("total_source"), F.col("total.valor").alias("total"),
        F.col("iva_total.valor").alias("vat_total"), F.col("iva_total.fuente").alias("vat_source"),
    )


BALANCE_SQL = _sql("id, true AS ok, CAST(total AS DECIMAL(20,2)) AS made, CAST(0 AS DECIMAL(20,2)) AS gap, 0 AS faults, 'aceptar' AS advice, 'FACTURA' AS tipo, CASE WHEN id % 3 <> 0 THEN 95 ELSE 85 END AS sure")


@query("balance_check", BALANCE_SQL)
def q_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = enriched(spark, sf_dir).select("id", "body", "qr", provenance.balance().alias("b"), provenance.failures().alias("f"))
    rows = rows.withColumn("kind", classify.classified(F.col("body"), F.col("qr.tipoCmp")))
    review = F.size("f") > 0
    return rows.select(
        "id", "b.ok", F.col("b.calculado").alias("made"), F.col("b.diferencia").alias("gap"), F.size("f").alias("faults"), provenance.recommendation(F.lit(False), review, F.col("body")).alias("advice"),
        F.col("kind.tipo_documento").alias("tipo"), F.col("kind.confianza").alias("sure"),
    )


FAULTS_SQL = f"""
WITH {render.FACTS_SQL},
u AS (SELECT 'TOTAL_MISMATCH' AS code, count(*) AS n FROM facts WHERE id % 5 = 0
      UNION ALL SELECT 'MISSING_CRITICAL_FIELD', count(*) FROM facts WHERE id % 7 = 0
      UNION ALL SELECT 'INVALID_CUIT', count(*) FROM facts WHERE id % 11 = 0)
SELECT code, n FROM u WHERE n > 0
"""


@query("validation_failures", FAULTS_SQL)
def q_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults by code once some documents' fields are spoilt."""
    def spoilt(name, when, v):
        f = F.col(name)
        return F.when(when, provenance.field(v, f["confianza"], f["fuente"], f["metodo"], f["evidencia"])).otherwise(f)

    rows = enriched(spark, sf_dir).withColumns(
        {
            "neto_gravado": spoilt("neto_gravado", F.col("id") % 5 == 0, (numbers.amount(F.col("neto_gravado.valor")) + 10).cast("string")),
            "fecha_emision": spoilt("fecha_emision", F.col("id") % 7 == 0, F.lit("")),
            "proveedor_cuit": spoilt("proveedor_cuit", F.col("id") % 11 == 0, F.lit("30-00000000-0")),
        }
    )
    rows = provenance.with_amounts(rows)
    return rows.select(F.explode(provenance.failures()).alias("f")).groupBy(F.col("f.codigo").alias("code")).agg(F.count("*").alias("n"))


MISMATCH_SQL = _sql("id, CASE WHEN id % 2 = 0 THEN ['total'] ELSE CAST([] AS VARCHAR[]) END AS differ")


@query("qr_text_mismatch", MISMATCH_SQL)
def q_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, q, lines = F.col("body"), F.col("_q"), F.col("_lines")
    docs = render.documents(spark, sf_dir).select("id", "body", payload.decode(F.col("url")).alias("_q"), text.folded_lines(c).alias("_lines"))
    said = (extract.total(c, lines) + F.when(F.col("id") % 2 == 0, 1).otherwise(0)).cast("string")
    pairs = {"proveedor_cuit": (ids.format_tax_id(q["cuit"]), extract.issuer_tax_id(c, lines)), "fecha_emision": (dates.iso_date(q["fecha"]), extract.issue_date(c)), "total": (numbers.money_text(q["importe"]), said)}
    rows = docs.select("id", *[x.alias(f"{s}_{n}") for n, pair in pairs.items() for s, x in zip("qt", pair, strict=True)])
    found = provenance.mismatches({n: (F.col(f"q_{n}"), F.col(f"t_{n}")) for n in pairs})
    return rows.select("id", F.transform(found, lambda x: x["campo"]).alias("differ"))


@query("profile_select", _sql("id, CASE WHEN o_custkey % 4 = 0 THEN 'qr_cuit' WHEN o_custkey % 4 = 1 THEN 'alias' WHEN o_custkey % 4 = 2 THEN 'alias_ambiguo' ELSE 'sin_perfil' END AS method, CASE WHEN o_custkey % 4 IN (0, 1) THEN '30000000007' END AS chosen"))
def q_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("o_custkey") % 4
    body = F.when(r == 1, F.concat(F.col("body"), F.lit("\nAcme Uno"))).when(r == 2, F.concat(F.col("body"), F.lit("\nAcme Uno y Acme Dos"))).otherwise(F.col("body"))
    found = profiles.select_profile(body, F.when(r == 0, "30-00000000-7"), F.lit(""), [], [("ACME UNO", "30000000007"), ("ACME DOS", "30000000015")], ["30000000007", "30000000015"])
    return render.documents(spark, sf_dir).select("id", found.alias("p")).select("id", "p.method", F.col("p.tax_id").alias("chosen"))


@query("profile_fill", _sql("id, CAST(total AS VARCHAR) AS valor, 80 AS confianza, 'perfil_proveedor' AS fuente, strftime(CAST(issued AS DATE), '%d/%m/%Y') AS due"))
def q_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("body")
    f = profiles.filled(provenance.empty(), c, "total", ["Nada", "Importe Total:"])
    d = profiles.filled(provenance.empty(), c, "vencimiento_cae", ["Fecha Vto. CAE"])
    return render.documents(spark, sf_dir).select("id", f.alias("f"), d.alias("d")).select("id", "f.valor", "f.confianza", "f.fuente", F.col("d.valor").alias("due"))


RECORD_SQL = _sql(
    "id, replace(tax_id, '-', '') AS tax_id, lpad(point, 5, '0') || '-' || number AS number, strftime(CAST(issued AS DATE), '%d/%m/%Y') AS issued, 'FACTURA' AS kind, CASE WHEN vat > 100 THEN vat END AS vat, total AS total, net AS subtotal, CASE WHEN vat > 100 THEN 0.91::DOUBLE ELSE 0.83::DOUBLE END AS confidence"
)


@query("advanced_record", RECORD_SQL)
def q_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second extractor's record of each document."""
    from docfacts.functions import advanced

    rows = render.documents(spark, sf_dir).select("id", advanced.record(F.col("body")).alias("r"))
    return rows.select("id", "r.tax_id", "r.number", "r.issued", "r.kind", "r.vat", "r.total", "r.subtotal", "r.confidence")


@query("jurisdiction_codes", "SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'Misiones' WHEN 1 THEN 'CABA' WHEN 2 THEN 'Entre Rios' ELSE '' END AS place, CASE o_orderkey % 4 WHEN 0 THEN '914' WHEN 1 THEN '901' WHEN 2 THEN '908' ELSE '' END AS code FROM orders")
def q_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docfacts.functions import advanced
    from docfacts.sources.tables import table

    k = F.col("o_orderkey")
    body = F.when(k % 4 == 0, "Perc. MNES 3%").when(k % 4 == 1, "Ciudad Autónoma de Buenos Aires").when(k % 4 == 2, "prov. de Entre Ríos").otherwise("otra parte")
    rows = table(spark, sf_dir, "orders").select(k.alias("id"), advanced.jurisdiction(body).alias("place"))
    return rows.select("id", "place", advanced.jurisdiction_code(F.col("place")).alias("code"))


PROCESS_SQL = _sql(
    "id, CASE WHEN id % 5 = 0 THEN 'REVIEW_REQUIRED' ELSE 'OK' END AS estado, 'FACTURA' AS tipo, CASE WHEN id % 2 = 0 THEN 'pdf_text' ELSE 'ocr' END AS total_source, "
    "CASE WHEN id % 2 = 0 THEN 85 ELSE 70 END AS sure, CASE WHEN id % 5 = 0 THEN 'revisar_manualmente' ELSE 'aceptar' END AS advice"
) + " WHERE id % 10 <> 3"


@query("process_documents", PROCESS_SQL)
def q_process(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New documents from both kinds of text to their diagnosis; every tenth is known already, every fifth has a wrong tax."""
    body = F.when(F.col("id") % 5 == 0, F.regexp_replace("body", "IVA 21%: .*", "IVA 21%: 1,00")).otherwise(F.col("body"))
    docs = render.documents(spark, sf_dir).select(
        "id", F.sha2(F.col("id").cast("string"), 256).alias("sha256"), F.when(F.col("id") % 2 == 0, body).otherwise("").alias("pdf_text"), F.when(F.col("id") % 2 == 1, body).otherwise("").alias("ocr_text"),
        payload.decode(F.lit("")).alias("qr"),
    )
    known = render.facts(spark, sf_dir).filter("id % 10 = 3").select(F.sha2(F.col("id").cast("string"), 256).alias("sha256"))
    rows = process.process(docs, known)
    return rows.select("id", "estado", F.col("clase.tipo_documento").alias("tipo"), F.col("total.fuente").alias("total_source"), F.col("total.confianza").alias("sure"), F.col("diagnostico.recomendacion").alias("advice"))


PERCEIVED_SQL = _sql(
    "id, CASE WHEN id % 4 = 0 THEN 'REVIEW_REQUIRED' ELSE 'OK' END AS estado, CAST(CAST(floor(net / 100) + 10 AS DECIMAL(18,2)) AS VARCHAR) AS percepcion, '914' AS codjur, "
    "CASE WHEN id % 4 = 0 THEN 'TOTAL_MISMATCH,QR_OCR_MISMATCH' ELSE '' END AS codigos"
)


@query("process_perceptions", PERCEIVED_SQL)
def q_perceived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose total holds a gross-income perception; every fourth has a payload with a total that doesn't."""
    perceived = (F.floor(F.col("net") / 100) + 10).cast("decimal(18,2)")
    rows = render.documents(spark, sf_dir).withColumns({"_x": perceived, "_t": (F.col("total") + perceived).cast("decimal(18,2)")})
    line = F.concat(F.lit("Percepción IIBB Misiones: $ "), numbers.argentine("_x"), F.lit("\nImporte Total: $ "), numbers.argentine("_t"), F.lit("\nCAE"))
    body = F.concat(F.get(F.split("body", "Importe Total: "), F.lit(0)), line, F.get(F.split("body", "\nCAE", 2), F.lit(1)))
    docs = rows.select("id", body.alias("pdf_text"), F.lit("").alias("ocr_text"), payload.decode(F.when(F.col("id") % 4 == 0, F.col("url")).otherwise("")).alias("qr"))
    done = process.process(docs)
    return done.select("id", "estado", F.col("percepciones_iibb.valor").alias("percepcion"), F.col("codjur.valor").alias("codjur"), F.array_join(F.transform("fallas", lambda f: f["codigo"]), ",").alias("codigos"))


@query("extract_plain_layout", _sql("id, letter, total, point, number, '30-00000000-0' AS tax_id"))
def q_plain_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A layout without labels: the letter ends a line, the table's heading is far from the total, the tax id's check digit is wrong."""
    parts = [
        F.concat(F.lit("ACME SERVICIOS SRL  "), F.col("letter")), F.lit("Direccion Mitre"), F.lit("FACTURA"), F.concat(F.lit("Comprobante "), F.col("point"), F.lit("-"), F.col("number")),
        F.lit("CUIT: 30-00000000-0"), F.lit("Cantidad Descripción Precio Unit."), F.lit("xx\n" * 60), F.lit("IVA TOTAL"), numbers.argentine("total"),
    ]
    docs = render.facts(spark, sf_dir).select("id", F.concat_ws("\n", *parts).alias("body"))
    c = F.col("body")
    rows = docs.select("id", extract.letter(c).alias("letter"), extract.total(c).alias("total"), extract.number(c).alias("n"), ids.first_tax_id(c).alias("tax_id"))
    return rows.select("id", "letter", "total", "n.point", "n.number", "tax_id")

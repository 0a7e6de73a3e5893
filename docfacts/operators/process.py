"""A document from its texts and payload to fields, checks, class and diagnosis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docfacts.functions import advanced, dates, extract, ids, numbers, text
from docfacts.operators import classify, dedupe, items, provenance


def issuer_name(c: Column) -> Column:
    """The second extractor's name of the issuer, else the first one's."""
    return F.coalesce(text.blank_to_null(advanced.provider_name(c)), extract.business_name(c))


def text_values(c: Column, number: str, lines: Column | None = None, up: Column | None = None) -> dict[str, Column]:
    """Each field's value in a text; ``number`` is the column with its point and number, ``lines`` its folded lines, ``up`` the text made caseless."""
    n = F.col(number)

    def given(v: Column) -> Column:
        return text.let(v, lambda x: F.when(x != "0.00", x))

    return {
        "proveedor_nombre": issuer_name(c), "proveedor_cuit": extract.issuer_tax_id(c, lines), "tipo_comprobante": extract.letter_kind(c), "punto_venta": n["point"], "numero_comprobante": n["number"],
        "fecha_emision": extract.issue_date(c), "moneda": extract.currency(c, up), "neto_gravado": given(extract.net_text(c, lines, up)), "iva_21": extract.vat_text(c, "21", lines, up),
        "iva_105": extract.vat_text(c, "10.5", lines, up), "iva_27": extract.vat_text(c, "27", lines, up), "percepciones_iva": given(extract.vat_perception(c, up)),
        "otros_tributos": given(extract.other_taxes(c, up)), "total": given(extract.total(c, lines).cast("string")), "cae": extract.authorisation(c), "vencimiento_cae": extract.expiry_date(c),
    }


#: Fields that a payload and a text must agree on.
COMPARED = ("proveedor_cuit", "punto_venta", "numero_comprobante", "fecha_emision", "total")


def coded_values(q: Column) -> dict[str, tuple[Column, str]]:
    """Each field's value in a payload, with the method's name."""
    return {
        "proveedor_cuit": (F.when(ids.valid_tax_id(q["cuit"]), ids.format_tax_id(q["cuit"])), "qr_cuit"), "tipo_comprobante": (F.concat(F.lit("FACTURA_"), ids.letter_of_code(q["tipoCmp"])), "qr_tipo_cmp"),
        "punto_venta": (ids.code_text(q["ptoVta"], 4), "qr_pto_vta"), "numero_comprobante": (ids.code_text(q["nroCmp"], 8), "qr_nro_cmp"), "fecha_emision": (dates.iso_date(q["fecha"]), "qr_fecha"),
        "moneda": (ids.currency(q["moneda"]), "qr_moneda"), "total": (numbers.money_text(q["importe"]), "qr_importe"), "cae": (q["codAut"], "qr_cod_aut"),
    }


def perception_fields(found: Column) -> dict[str, Column]:
    """The sum of a text's gross-income perceptions, and the code of the first one's province."""
    total = F.aggregate(F.transform(found, lambda x: x["importe"]), F.lit(0).cast("decimal(18,2)"), lambda n, x: (n + x).cast("decimal(18,2)"))
    said = F.array_join(F.transform(found, lambda x: F.concat_ws(" ", x["jurisdiccion"], x["codjur"], x["importe"].cast("string"))), "; ")
    values = {"percepciones_iibb": F.when(F.size(found) > 0, total), "codjur": F.get(found, F.lit(0))["codjur"]}
    return {n: provenance.field(v, 80, "ocr", "perception_detail", said) for n, v in values.items()}


def with_fields(docs: DataFrame) -> DataFrame:
    """``docs`` (.., pdf_text, ocr_text, qr) with a record for each field: payload first, then PDF text, then OCR text where it differs.

    ``difieren`` lists the fields in which the payload and the text (the PDF's, else
    the OCR's) disagree. Lines, numbers and values come in projections of their own, for
    each is used several times; a blank text is not searched.
    """
    keep = docs.columns
    pdf, ocr = F.btrim(F.coalesce("pdf_text", F.lit(""))), F.btrim(F.coalesce("ocr_text", F.lit("")))
    some = docs.withColumns({"_p": F.when(pdf != "", F.col("pdf_text")), "_o": F.when((ocr != "") & (ocr != pdf), F.col("ocr_text"))})
    each = {"p": F.col("_p"), "o": F.col("_o")}
    body = F.coalesce("_p", "_o")
    some = some.withColumns(
        {f"_{s}n": F.when(c.isNotNull(), extract.number(c)) for s, c in each.items()} | {f"_{s}l": F.when(c.isNotNull(), text.folded_lines(c)) for s, c in each.items()} | {f"_{s}u": F.when(c.isNotNull(), text.caseless(c)) for s, c in each.items()} | {"_iibb": items.perceptions(body)}
    )
    p, o = (text_values(c, f"_{s}n", F.col(f"_{s}l"), F.col(f"_{s}u")) for s, c in each.items())
    coded = coded_values(F.col("qr"))
    values = some.select(
        *keep, "_iibb", F.to_json("qr").alias("_json"), *[F.when(F.col(s).isNotNull(), v).alias(f"{s}_{n}") for s, of in (("_p", p), ("_o", o)) for n, v in of.items()], *[v.alias(f"_q_{n}") for n, (v, _) in coded.items()]
    )
    fields = perception_fields(F.col("_iibb"))
    for n in p:
        ways = [(F.col(f"_q_{n}"), provenance.QR, "qr", coded[n][1], F.col("_json"))] if n in coded else []
        ways += [(F.col(f"{s}_{n}"), sure, source, f"regex_{n}", F.col(f"{s}_{n}")) for s, sure, source in (("_p", provenance.PDF, "pdf_text"), ("_o", provenance.OCR, "ocr"))]
        fields[n] = provenance.first_given(*ways)
    said = {n: F.when(F.btrim(F.coalesce("pdf_text", F.lit(""))) != "", F.col(f"_p_{n}")).otherwise(F.col(f"_o_{n}")) for n in COMPARED}
    differ = provenance.mismatches({n: (F.col(f"_q_{n}"), said[n]) for n in COMPARED})
    rows = values.select(*keep, *[f.alias(n) for n, f in fields.items()], differ.alias("difieren"))
    rows = provenance.with_amounts(rows).withColumns(provenance.resolve_double_tax())
    return provenance.with_amounts(rows, provenance.DOUBLE).withColumn("iva_total", provenance.vat_total())


def process(docs: DataFrame, known: DataFrame | None = None, key: str = "sha256") -> DataFrame:
    """Fields, failures, balance, class (``clase``), state and ``diagnostico`` of each document that ``known`` doesn't hold.

    The anti-join comes first, so nothing is extracted from a document seen before.
    """
    fresh = docs if known is None else dedupe.unseen(docs, key, known)
    rows = with_fields(fresh)
    body = F.coalesce(F.nullif(F.btrim("pdf_text"), F.lit("")), F.col("ocr_text"))
    rows = rows.withColumns({"fallas": F.concat(provenance.failures(), F.transform("difieren", lambda x: F.struct(x["codigo"], x["campo"]))), "balance": provenance.balance(), "clase": classify.classified(body, F.when(F.col("qr").isNotNull(), F.coalesce(F.col("qr")["tipoCmp"], F.lit(""))))})
    review = (F.size("fallas") > 0) | F.col("clase.requiere_revision")
    advice = F.when(F.col("clase.tipo_documento") == "ILEGIBLE", "reintentar").when(F.col("clase.requiere_revision"), "ignorar_no_fiscal").otherwise(provenance.recommendation(F.lit(False), review, body))
    return rows.withColumns(
        {
            "estado": F.when(F.size("fallas") > 0, "REVIEW_REQUIRED").otherwise("OK"),
            "diagnostico": F.struct(review.alias("requiere_revision"), provenance.found_names().alias("encontrados"), provenance.missing_names().alias("faltantes"), advice.alias("recomendacion")),
        }
    ).drop(*[c for c in rows.columns if c.startswith("_m_")])

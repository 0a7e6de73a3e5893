"""The type of a document from its payload or its words."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from docfacts.functions import ids, text

# Words of each type, in the order tried; those with \b are patterns.
KEYWORDS = {
    "NOTA_CREDITO": ("NOTA DE CREDITO", "NOTA DE CRÉDITO", "NOTA CREDITO", "NOTA CRÉDITO", "NOTA DE CRED.", "NOTA CRED.", r"\bNC\b"),
    "NOTA_DEBITO": ("NOTA DE DEBITO", "NOTA DE DÉBITO", "NOTA DEBITO", "NOTA DÉBITO", "NOTA DE DEB.", "NOTA DEB.", r"\bND\b"),
    "FACTURA": ("FACTURA", r"\bFO\d{2}\b", r"\bFE\b", "COMPROBANTE A", "COMPROBANTE B", "COMPROBANTE C", "COMPROBANTE M", "CAE N", "CAE NÚMERO", "CAE NUMERO"),
    "REMITO": ("REMITO", "RTO", "COMPROBANTE DE ENTREGA", "REMITO N"),
    "COMPROBANTE_PAGO": (
        "COMPROBANTE DE PAGO", "RECIBO", "PAGO REALIZADO", "TRANSFERENCIA", "MERCADO PAGO", "MERCADOPAGO", r"\bCBU\b", r"\bALIAS\b", "OPERACIÓN", "OPERACION",
    ),
    "ORDEN_COMPRA": ("ORDEN DE COMPRA", r"\bOC\b", "PURCHASE ORDER", "PEDIDO DE COMPRA"),
}
CONFIDENCE = {"NOTA_CREDITO": 85, "NOTA_DEBITO": 85, "FACTURA": 85, "REMITO": 80, "COMPROBANTE_PAGO": 75, "ORDEN_COMPRA": 75}
NO_INVOICE = ("REMITO", "COMPROBANTE_PAGO", "ORDEN_COMPRA", "OTRO_DOCUMENTO", "ILEGIBLE")


def has_word(upper: Column, words: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | (matches(upper, w) if w.startswith("\\b") else F.contains(upper, F.lit(w)))
    return found


def matches(upper: Column, word: str) -> Column:
    """A pattern of a word, tried only where the letters that it begins with are."""
    return F.contains(upper, F.lit(re.match(r"\\b([A-Z]+)", word)[1])) & upper.rlike(f"(?U){word}")


def by_words(body: Column, up: Column | None = None) -> Column:
    """The type by the words of a text, of which ``up`` are the capitals if they are there already."""
    if up is None:
        return text.let(F.upper(body), lambda x: by_words(body, x))
    out = F.when(F.btrim(F.coalesce(body, F.lit(""))) == "", "ILEGIBLE")
    for kind, words in KEYWORDS.items():
        out = out.when(has_word(up, words), kind)
    return out.otherwise("OTRO_DOCUMENTO")


def classified(body: Column, code: Column | None = None) -> Column:
    """Struct (tipo_documento, confianza, fuente, metodo, evidencia, requiere_revision); ``code`` is the payload's document code, '' if it has none, null without payload."""
    def record(x):
        body, up, kind = x["body"], x["up"], x["kind"]
        score = F.when(kind == "ILEGIBLE", 0)
        at = F.when(kind == "ILEGIBLE", 0)
        for k, words in KEYWORDS.items():
            score = score.when(kind == k, CONFIDENCE[k])
            hit = F.lit(0)
            for w in reversed(words):
                hit = F.when(matches(up, w), 0).otherwise(hit) if w.startswith("\\b") else F.when(F.contains(up, F.lit(w)), F.instr(up, w) * 100 + len(w)).otherwise(hit)
            at = at.when(kind == k, hit)

        def shown(at):
            start = F.greatest(F.floor(at / 100) - 10, F.lit(1)).cast("int")
            near = F.substring(body, start, (F.floor(at / 100) - start + at % 100 + 30).cast("int"))
            return (
                F.when(kind == "ILEGIBLE", "no se pudo extraer texto del archivo").when(kind == "OTRO_DOCUMENTO", text.cut_words(body, 80)).when(at > 0, text.cut_words(near, 60)).otherwise(text.cut_words(body, 60))
            )

        return F.struct(
            kind.alias("tipo_documento"), score.otherwise(60).alias("confianza"), F.when(kind == "ILEGIBLE", "empty").otherwise("regex").alias("fuente"),
            F.when(kind == "ILEGIBLE", "no_text").when(kind == "OTRO_DOCUMENTO", "no_matching_keywords").otherwise(F.concat(F.lit("regex_"), F.lower(kind))).alias("metodo"),
            text.let(at.otherwise(0), shown).alias("evidencia"), kind.isin(*NO_INVOICE).alias("requiere_revision"),
        )

    def typed(x):
        return F.struct(x["body"].alias("body"), x["up"].alias("up"), by_words(x["body"], x["up"]).alias("kind"))

    own = text.let(text.let(F.struct(body.alias("body"), F.upper(body).alias("up")), typed), record)
    if code is None:
        return own
    mapped = ids.type_of_code(code)
    coded = F.struct(
        F.coalesce(mapped, F.lit("FACTURA")).alias("tipo_documento"), F.when(mapped.isNotNull(), 95).otherwise(90).alias("confianza"), F.lit("qr_afip").alias("fuente"),
        F.lit("qr_afip_detected").alias("metodo"),
        F.when(mapped.isNotNull(), F.concat(F.lit("QR AFIP tipo comprobante "), code)).otherwise("QR AFIP detectado con datos fiscales").alias("evidencia"),
        F.lit(False).alias("requiere_revision"),
    )
    return F.when(code.isNotNull(), coded).otherwise(own)

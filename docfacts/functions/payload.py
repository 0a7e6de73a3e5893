"""Fiscal payload of a document's QR code: a URL with base64 JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docfacts.functions.text import blank_to_null, let

#: Numbers stay text, so no digit is lost.
FIELDS = "ver string, fecha string, cuit string, ptoVta string, tipoCmp string, nroCmp string, importe string, moneda string, codAut string"
KEYS = ("cuit", "ptoVta", "tipoCmp", "nroCmp", "importe")


def decode(c: Column) -> Column:
    """Struct of the payload in ``p`` or ``P`` of a URL, or of bare base64; null unless one of the main keys is there."""
    raw = F.coalesce(blank_to_null(F.regexp_extract(c, r"[?&][pP]=([^&#]+)", 1)), F.when(~F.contains(c, F.lit("://")), c))
    plain = F.translate(F.regexp_replace(raw, "%3D|=", ""), "-_", "+/")
    full = let(plain, lambda x: F.rpad(x, F.ceil(F.length(x) / 4).cast("int") * 4, "="))
    json = F.try_to_binary(full, F.lit("base64")).cast("string")

    def checked(data):
        known = F.lit(False)
        for key in KEYS:
            known = known | data[key].isNotNull()
        return F.when(known, data)

    return let(F.from_json(json, FIELDS), checked)


def encode(data: Column) -> Column:
    """URL-safe base64 of a struct's JSON, without padding."""
    return F.regexp_replace(F.translate(F.base64(F.encode(F.to_json(data), "utf-8")), "+/", "-_"), "=+$", "")

"""Tax ids, document codes and their formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docfacts.functions.text import blank_to_null, let

# Weights of the tax id's check digit; document codes by type and letter.
CHECK_WEIGHTS = (5, 4, 3, 2, 7, 6, 5, 4, 3, 2)
CODES = {
    ("FACTURA", "A"): "001",
    ("FACTURA", "B"): "006",
    ("FACTURA", "C"): "011",
    ("NOTA_DEBITO", "A"): "002",
    ("NOTA_DEBITO", "B"): "007",
    ("NOTA_DEBITO", "C"): "012",
    ("NOTA_CREDITO", "A"): "003",
    ("NOTA_CREDITO", "B"): "008",
    ("NOTA_CREDITO", "C"): "013",
}
# Document type of each payload code.
CODE_TYPES = {
    "FACTURA": (1, 6, 11, 15, 19, 34, 39, 43, 49, 52),
    "NOTA_DEBITO": (2, 7, 12, 20, 35, 40, 44, 50, 53),
    "NOTA_CREDITO": (3, 8, 13, 21, 36, 41, 45, 51, 54),
}
MIME_EXTENSIONS = {"application/pdf": "pdf", "image/jpeg": "jpg", "image/png": "png", "image/webp": "webp"}


def digits(c: Column) -> Column:
    return F.regexp_replace(c.cast("string"), r"\D", "")


def padded(c: Column, width: int) -> Column:
    """Zeros before shorter texts; longer ones stay whole."""
    return F.when(F.length(c) >= width, c).otherwise(F.lpad(c, width, "0"))


def code_text(c: Column, width: int) -> Column:
    """Padded digits of a value; null if it has none."""
    return let(digits(c), lambda d: F.when(d != "", padded(d, width)))


def check_digit(first_ten: Column) -> Column:
    def total(x):
        return sum((F.substring(x, i + 1, 1).try_cast("int") * w for i, w in enumerate(CHECK_WEIGHTS[1:], 1)), F.substring(x, 1, 1).try_cast("int") * CHECK_WEIGHTS[0])

    return let(11 - let(first_ten, total) % 11, lambda r: F.when(r == 11, 0).when(r == 10, 9).otherwise(r))


def valid_tax_id(d: Column) -> Column:
    """Eleven digits with a right check digit."""
    return F.coalesce(let(d, lambda x: x.rlike(r"^\d{11}$") & (check_digit(x) == F.substring(x, 11, 1).try_cast("int"))), F.lit(False))


def format_tax_id(c: Column) -> Column:
    def dashed(x):
        d = digits(x)
        return F.when(F.length(d) == 11, F.regexp_replace(d, r"^(\d{2})(\d{8})(\d)$", "$1-$2-$3")).otherwise(F.coalesce(x, F.lit("")))

    return let(c.cast("string"), dashed)


# Fixed value: a tax id with or without its label.
LABELLED_TAX_ID = r"(?i)\b(?:CUIT|C\.?U\.?I\.?T\.?)?\s*[:#-]?\s*(\d{2}[- ]?\d{8}[- ]?\d)\b"


def first_tax_id(text: Column) -> Column:
    """The first candidate with a right check digit; else the first labelled or plain one, whatever its check digit; else empty."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"(\b\d{2}[- ]?\d{8}[- ]?\d\b|\b\d{11}\b)")), digits)
    good = F.get(F.filter(found, valid_tax_id), F.lit(0))
    return F.coalesce(*[blank_to_null(format_tax_id(c)) for c in (good, F.regexp_extract(text, LABELLED_TAX_ID, 1))], F.lit(""))


def letter_of_code(c: Column) -> Column:
    n = digits(c).try_cast("int")
    return (
        F.when(n.between(1, 5) | n.isin(201, 202, 203), "A").when(n.between(6, 10) | n.isin(206, 207, 208), "B").when(n.between(11, 15) | n.isin(211, 212, 213), "C").when(n.between(51, 54), "M")
    )


def code_of_type(kind: Column, letter: Column) -> Column:
    name = F.regexp_replace(F.regexp_replace(F.upper(kind), "[^A-Z]", "_"), "^_+|_+$", "")
    out = F
    for (t, x), code in CODES.items():
        out = out.when((name == t) & (F.upper(letter) == x), code)
    return out.otherwise("")


def type_of_code(c: Column) -> Column:
    n = c.try_cast("int")
    out = F
    for kind, codes in CODE_TYPES.items():
        out = out.when(n.isin(*codes), kind)
    return out.otherwise(F.lit(None).cast("string"))


def currency(c: Column) -> Column:
    code = F.upper(F.trim(c))
    return F.when(code.isin("PES", "ARS"), "ARS").when(code.isin("DOL", "USD"), "USD").when(F.length(code) == 3, code).otherwise("")


def extension(mime: Column) -> Column:
    out = F
    for m, e in MIME_EXTENSIONS.items():
        out = out.when(F.lower(mime) == m, e)
    return out.otherwise("bin")


# Types of files by suffix, and of any other.
CONTENT_TYPES = {
    "pdf": "application/pdf", "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "json": "application/json; charset=utf-8", "xml": "application/xml; charset=utf-8",
    "txt": "text/plain; charset=utf-8",
}
ANY_TYPE = "application/octet-stream"


def content_type(path: Column) -> Column:
    """The type of a file by its suffix."""
    types = F.create_map(*[F.lit(x) for pair in CONTENT_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(types, F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))), F.lit(ANY_TYPE))


def hamming(a: Column, b: Column, hex_digits: int) -> Column:
    """Bits that differ between two hexadecimal hashes; 9999 if either is blank or of another length."""
    total = F.lit(0)
    for at in range(1, hex_digits + 1, 8):
        x, y = (F.conv(F.substring(c, at, 8), 16, 10).cast("long") for c in (a, b))
        total = total + F.bit_count(x.bitwiseXOR(y))
    good = (F.length(a) == hex_digits) & (F.length(b) == hex_digits)
    return F.when(F.coalesce(good, F.lit(False)), total).otherwise(9999)

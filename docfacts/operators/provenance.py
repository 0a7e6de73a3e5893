"""Fields with their source, confidence, method and evidence; checks over them; what to do with the document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docfacts.functions import ids, numbers, text

# Names of the fields, those a document can't do without, those that make up the total, and confidences of sources.
FIELDS = (
    "proveedor_nombre", "proveedor_cuit", "tipo_comprobante", "punto_venta", "numero_comprobante", "fecha_emision", "moneda", "neto_gravado", "iva_21", "iva_105",
    "iva_27", "iva_total", "percepciones_iibb", "percepciones_iva", "otros_tributos", "total", "codjur", "cae", "vencimiento_cae",
)
CRITICAL = ("proveedor_cuit", "tipo_comprobante", "punto_venta", "numero_comprobante", "fecha_emision", "total")
DOUBLE = ("percepciones_iibb", "otros_tributos")
COMPONENTS = ("neto_gravado", "iva_21", "iva_105", "iva_27", "percepciones_iibb", "percepciones_iva", "otros_tributos")
QR, PDF, OCR, COMPUTED, PROFILE = 98, 85, 70, 90, 80
TOLERANCE = 1.00

FIELD = "struct<valor:string,confianza:int,fuente:string,metodo:string,evidencia:string>"


def empty() -> Column:
    return F.struct(F.lit(None).cast("string").alias("valor"), F.lit(0).alias("confianza"), F.lit("vacio").alias("fuente"), F.lit("not_found").alias("metodo"), F.lit("").alias("evidencia"))


def field(value: Column, confidence, source, method, evidence) -> Column:
    """A field's record; the empty one if the value is null or blank."""
    return first_given((value, confidence, source, method, evidence))


def first_given(*ways: tuple) -> Column:
    """The record of the first of several (value, confidence, source, method, evidence) whose value is neither null nor blank; the empty one."""
    def col(x):
        return x if isinstance(x, Column) else F.lit(x)

    out = F
    for value, confidence, source, method, evidence in ways:
        v = value.cast("string")
        made = F.struct(
            v.alias("valor"), col(confidence).cast("int").alias("confianza"), col(source).alias("fuente"), col(method).alias("metodo"),
            F.substring(F.btrim(F.coalesce(col(evidence), F.lit(""))), 1, 500).alias("evidencia"),
        )
        out = out.when(v != "", made)
    return out.otherwise(empty())


def first_of(*fields: Column) -> Column:
    """The first field that has a value: sources in the order of trust."""
    out = fields[-1]
    for f in reversed(fields[:-1]):
        out = F.when(f["valor"].isNotNull(), f).otherwise(out)
    return out


def value(f: str) -> Column:
    return F.col(f)["valor"]


def with_amounts(df: DataFrame, names: tuple[str, ...] = (*COMPONENTS, "total")) -> DataFrame:
    """Adds the decimal of each amount field once, for the checks below, which read them many times."""
    return df.withColumns({f"_m_{n}": numbers.amount(value(n)) for n in names})


def money(f: str) -> Column:
    return F.col(f"_m_{f}")


def components_sum() -> Column:
    """Sum of the components that have a value; null if none has."""
    some = F.coalesce(*[money(n) for n in COMPONENTS])
    total = sum((F.coalesce(money(n), F.lit(0).cast(numbers.MONEY)) for n in COMPONENTS[1:]), F.coalesce(money(COMPONENTS[0]), F.lit(0).cast(numbers.MONEY)))
    return F.when(some.isNotNull(), total.cast("decimal(20,2)"))


def balance(tolerance: float = TOLERANCE) -> Column:
    """Struct (ok, calculado, total, diferencia): does the total equal its components; with nothing to compare it does."""
    made, total = components_sum(), money("total")
    gap = F.abs(total - made).cast("decimal(20,2)")
    return F.struct(F.coalesce(gap <= tolerance, F.lit(True)).alias("ok"), F.when(total.isNotNull(), made).alias("calculado"), total.alias("total"), F.coalesce(gap, F.lit(0).cast("decimal(20,2)")).alias("diferencia"))


def failures(tolerance: float = TOLERANCE) -> Column:
    """Array of (codigo, campo) of every rule that the fields break."""
    def fault(when: Column, code: str, name: str) -> Column:
        return F.when(when, F.struct(F.lit(code).alias("codigo"), F.lit(name).alias("campo")))

    found = []
    for n in CRITICAL:
        missing = F.coalesce(value(n), F.lit("")) == ""
        found += [fault(missing, "MISSING_CRITICAL_FIELD", n), fault(~missing & (F.col(n)["confianza"] < 60), "LOW_CONFIDENCE", n)]
    cuit = F.coalesce(value("proveedor_cuit"), F.lit(""))
    found.append(fault((cuit != "") & ~ids.valid_tax_id(ids.digits(cuit)), "INVALID_CUIT", "proveedor_cuit"))
    found.append(fault(F.coalesce(money("total") <= 0, F.lit(True)), "INVALID_TOTAL", "total"))
    found.append(fault(~balance(tolerance)["ok"], "TOTAL_MISMATCH", "total"))
    return F.array_compact(F.array(*found))


def mismatches(pairs: dict[str, tuple[Column, Column]]) -> Column:
    """Array of (codigo, campo, qr, texto) where both sources have a value and they differ."""
    def one(name, qr, txt):
        both = (F.coalesce(qr, F.lit("")) != "") & (F.coalesce(txt, F.lit("")) != "") & (qr != txt)
        return F.when(both, F.struct(F.lit("QR_OCR_MISMATCH").alias("codigo"), F.lit(name).alias("campo"), qr.alias("qr"), txt.alias("texto")))

    return F.array_compact(F.array(*[one(n, q, t) for n, (q, t) in pairs.items()]))


def resolve_double_tax(tolerance: float = TOLERANCE) -> dict[str, Column]:
    """Other taxes and gross-income perceptions that are one tax under two labels: new columns for both fields (``DOUBLE``)."""
    zero = F.lit(0).cast(numbers.MONEY)
    other, own, total = money("otros_tributos"), money("percepciones_iibb"), money("total")
    base = sum((F.coalesce(money(n), zero) for n in ("iva_21", "iva_105", "iva_27")), F.coalesce(money("neto_gravado"), zero))
    both = (other > 0) & (own > 0)
    moved = both & (own != other) & (F.abs(base + other - total) <= tolerance) & ~(F.abs(base + own - total) <= tolerance)
    taken = field(
        other.cast("decimal(18,2)"), F.greatest(F.col("percepciones_iibb")["confianza"], F.lit(80)), F.col("otros_tributos")["fuente"], "otros_tributos_iibb_balance", F.col("otros_tributos")["evidencia"]
    )
    return {
        "percepciones_iibb": F.when(moved, taken).otherwise(F.col("percepciones_iibb")),
        "otros_tributos": F.when(moved | (both & (own == other)), empty()).otherwise(F.col("otros_tributos")),
    }


def vat_total() -> Column:
    """The sum of the rates' taxes as a computed field."""
    names = ("iva_21", "iva_105", "iva_27")
    zero = F.lit(0).cast(numbers.MONEY)
    total = sum((F.coalesce(money(n), zero) for n in names[1:]), F.coalesce(money(names[0]), zero)).cast("decimal(18,2)")
    return field(F.when(F.coalesce(*[money(n) for n in names]).isNotNull(), total), COMPUTED, "calculado", "sum_iva_rates", F.concat_ws(" + ", *[value(n) for n in names]))


def sane_perception(amount: Column, total: Column, cuit: Column, references: list[Column]) -> Column:
    """A perception amount if it is plausible, else 0: not the tax id, not above the total or every reference, below a million without references."""
    whole = F.floor(amount).cast("string")
    top = F.greatest(*[F.when(r > 0, r) for r in references]) if len(references) > 1 else F.when(references[0] > 0, references[0])
    is_id = F.coalesce(whole == text.blank_to_null(ids.digits(cuit)), F.lit(False))
    bad = F.coalesce(amount <= 0, F.lit(True)) | is_id | F.coalesce((total > 0) & (amount > total), F.lit(False)) | F.coalesce(amount > top, amount >= 1_000_000)
    return F.when(bad, F.lit(0).cast(numbers.MONEY)).otherwise(amount)


def recommendation(duplicate: Column, review: Column, body: Column) -> Column:
    return (
        F.when(duplicate, "ignorar_duplicado").when(review & (F.btrim(F.coalesce(body, F.lit(""))) == ""), "reintentar").when(review, "revisar_manualmente").otherwise("aceptar")
    )


def found_names() -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(value(n), F.lit("")) != "", n) for n in FIELDS]))


def missing_names() -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(value(n), F.lit("")) == "", n) for n in CRITICAL]))

"""The second extractor: a record from trimmed lines, by labels and their neighbourhood."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from docfacts.functions import dates, ids, numbers, text
from docfacts.functions.text import blank_to_null, fold, let

# Labels and marks, in the order tried.
DATE_LABELS = ("fecha de emisión", "fecha de emision", "fecha de factura", r"f\.?\s*emisi[oó]n", r"fecha\s*:\s*")
DATE_SKIP = "vto|venc|cae|facturado desde|hasta|inicio"
NUMBERS = (
    r"Punto de Venta[:\s]*([0-9]{1,5}).{0,40}?Comp\.?\s*Nro\.?[:\s]*([0-9]{1,8})",
    r"Pto\.?\s*Vta\.?[:\s]*([0-9]{1,5}).{0,40}?Comp\.?\s*Nro\.?[:\s]*([0-9]{1,8})",
    r"Nro\.?[:\s]*([0-9]{1,5})[-\s]*([0-9]{1,8})",
    r"Comprobante[:\s]*([0-9]{1,5})[-\s]*([0-9]{1,8})",
    r"\b([0-9]{4,5})\s*[-–—]\s*([0-9]{6,8})\b",
)
CUSTOMER_MARKS = r"apellid[oó]\s+y\s+nombre\s*/\s*raz[oó]n\s+social|sr\s*\(es\)|sr/es|cliente|domicilio\s+comercial"
CUSTOMER_WORDS = ("NOMBRE", "SR", "ENTE", "COMERC")  # one is in each of them
NAME_LABEL = r"(?:RAZ[ÓO]N SOCIAL|PROVEEDOR|EMISOR|TITULAR)[:\s-]*([^\n]+)"
COMPANY = r"\bS\.?A\.?S?\b|\bS\.?R\.?L\.?\b|SOCIEDAD\s+ANONIMA|SOCIEDAD\s+DE\s+RESPONSABILIDAD\s+LIMITADA|SOCIEDAD\s+POR\s+ACCIONES\s+SIMPLIFICADA"
SKIP_WORDS = (
    "ORIGINAL", "COPIA", "DUPLICADO", "TRIPLICADO", "FACTURA", "NOTA DE CRÉDITO", "NOTA DE CREDITO", "NOTA DE DÉBITO", "NOTA DE DEBITO", "CAE", "COMPROBANTE", "AUTORIZADO", "PÁG", "PAG", "FECHA",
    "VENCE", "VTO", "TOTAL", "SUBTOTAL", "IVA", "CUIT", "DOMICILIO", "TEL", "TEL.",
)
STREET = r"\b(?:AV|CALLE|RUTA|PASAJE|DIRECCION|DIRECCIÓN|HUERGO|QUIROGA|CORDOBA|PUERTO|MISIONES)\b"
PLACE_ALIASES = (("CAPITAL FEDERAL", "CABA"), ("CABA", "CABA"), ("CIUDAD AUTONOMA DE BUENOS AIRES", "CABA"), ("MISION", "MISIONES"), ("MNES", "MISIONES"))
SUBTOTAL_WORDS, TOTAL_WORDS = ("NETO", "SUB"), ("TOTAL", "PAGAR")
SUBTOTAL, TOTAL = r"importe\s+neto\s+gravado|sub\s*total|subtotal", r"importe\s+total|total\s+a\s+pagar|importe\s+a\s+pagar|^total\b"
I = "(?iu)"  # noqa: E741


def searched(c: Column) -> Column:
    """Struct (ls, up) of a text's lines and of the same folded: what the searches of one text share."""
    return let(text.lines(c), lambda ls: F.struct(ls.alias("ls"), F.transform(ls, fold).alias("up")))


def in_text(c: Column, e: Column | None, then: Callable[[Column], Column]) -> Column:
    """``then`` of a text's ``searched``, made here unless it is there already."""
    return let(searched(c), then) if e is None else then(e)


def kind(c: Column, e: Column | None = None) -> Column:
    """FACTURA, NOTA_CREDITO or NOTA_DEBITO from a line of its own near the top, else from anywhere; DESCONOCIDO. ``e`` is the text's ``searched``, here and below, if it is there already."""
    def alone(x):
        tail = r"(?:\s+[A-Z0-9./-]+)?$"
        return F.when(x.rlike("^FACTURA" + tail), "FACTURA").when(x.rlike(r"^NOTA\s+DE\s+CR[ÉE]DITO" + tail), "NOTA_CREDITO").when(x.rlike(r"^NOTA\s+DE\s+D[ÉE]BITO" + tail), "NOTA_DEBITO")

    def top(e):
        heads = F.filter(F.transform(F.slice(e["ls"], 1, 25), lambda x: F.upper(x)), lambda x: F.startswith(x, F.lit("FACTURA")) | F.startswith(x, F.lit("NOTA")))
        return F.get(F.filter(F.transform(heads, alone), lambda x: x.isNotNull()), F.lit(0))

    up = F.upper(c)
    return F.coalesce(
        in_text(c, e, top), F.when(up.rlike(r"(?u)\bNOTA\s+DE\s+CR[ÉE]DITO\b"), "NOTA_CREDITO").when(up.rlike(r"(?u)\bNOTA\s+DE\s+D[ÉE]BITO\b"), "NOTA_DEBITO").when(up.rlike(r"\bFACTURA\b"), "FACTURA"), F.lit("DESCONOCIDO")
    )


def number(c: Column) -> Column:
    """'00001-00000001' of the first pattern that matches, else empty."""
    def by(pattern):
        def joined(found):
            a, b = (F.regexp_extract(found, pattern, i) for i in (1, 2))
            return F.concat(ids.padded(a, 5), F.lit("-"), ids.padded(b, 8))

        return let(blank_to_null(F.regexp_extract(c, pattern, 0)), joined)

    return F.coalesce(*[by("(?ius)" + p) for p in NUMBERS], F.lit(""))


def tax_id(c: Column) -> Column:
    """Digits of the first labelled valid id, else of the first valid one, else empty."""
    tried = []
    for p in (r"C[UÜVLI1|]{1,3}T[:\s\-—]*([0-9]{2}-?[0-9]{8}-?[0-9])", r"\b([0-9]{2}-?[0-9]{8}-?[0-9])\b"):
        d = ids.digits(F.regexp_extract(c, I + p, 1))
        tried.append(let(d, lambda x: F.when(ids.valid_tax_id(x), x)))
    rest = F.filter(F.regexp_extract_all(c, F.lit(r"(\b\d{11}\b)")), ids.valid_tax_id)
    return F.coalesce(*tried, F.get(rest, F.lit(0)), F.lit(""))


def issue_date(c: Column, e: Column | None = None) -> Column:
    """The date on a labelled line or in the six lines after it, labels in order; else the first anywhere; else empty."""
    def in_lines(e):
        ls = e["ls"]

        def near(line, i):
            return F.get(F.filter(F.transform(F.slice(ls, i + 1, 7), dates.token), lambda x: x != ""), F.lit(0))

        def beside(label):
            found = F.transform(ls, lambda x, i: F.when(x.rlike(I + label) & ~F.lower(x).rlike(DATE_SKIP), near(x, i)))
            return F.get(F.filter(found, lambda x: x.isNotNull()), F.lit(0))

        tried = [beside(label) for label in DATE_LABELS]
        return F.coalesce(*tried, F.get(F.filter(F.transform(ls, dates.token), lambda x: x != ""), F.lit(0)), F.lit(""))

    return in_text(c, e, in_lines)


def line_amount(line: Column) -> Column:
    """The last amount of a line."""
    return F.bround(numbers.last_token(F.try_element_at(numbers.tokens(line), F.lit(-1))), 2).cast(numbers.MONEY)


def amount_near(c: Column, labels: str, back: int = 4, forward: int = 5, e: Column | None = None, words: tuple[str, ...] = ()) -> Column:
    """The amount nearest to the lowest labelled line that has one about it; on a tie the one after. ``words`` are such that no label is without one of them (see ``text.has``)."""
    def in_lines(e):
        ls = e["ls"]

        def near(i):
            start = F.greatest(i - back, F.lit(0))
            around = F.slice(ls, start + 1, i - start + forward + 1)
            found = F.filter(F.transform(around, lambda x, k: F.struct(F.abs(k + start - i).alias("far"), F.when(k + start >= i, 0).otherwise(1).alias("before"), line_amount(x).alias("amount"))), lambda x: x["amount"].isNotNull())
            return F.array_min(found)["amount"]

        def best(line, i):
            labelled = F.lower(line).rlike(I + labels)
            return F.when(text.has(F.get(e["up"], i), *words) & labelled if words else labelled, F.coalesce(line_amount(line), near(i)))

        return F.try_element_at(F.filter(F.transform(ls, best), lambda x: x.isNotNull()), F.lit(-1))

    return in_text(c, e, in_lines)


# Marks of currencies, in the order tried, and of any other; labels of totals.
CURRENCIES = ((r"\b(?:U\$S|USD|DOLAR(?:ES)?)\b", "USD"), (r"\b(?:EUR|EUROS?)\b", "EUR"))
OTHER_CURRENCY = "ARS"
SUBTOTAL_LABELS = (r"importe neto gravado", r"\bsubtotal\b")
VAT_LABELS = (r"\biva\b(?:\s*contenido)?\s*:|\biva\b", r"impuesto al valor agregado|impuesto interno")
PERCEPTION_LABELS = r"percepciones\s*iibb|percepcion\s*iibb|percepciones\s+ingresos\s+brutos|ingresos brutos"
TOTAL_LABELS = r"\bimporte total\s*:|\btotal\s*:|total a pagar|importe a pagar"


def currency(c: Column) -> Column:
    """USD or EUR where a text names it, else ARS."""
    out = F
    for pattern, code in CURRENCIES:
        out = out.when(F.upper(c).rlike(pattern), code)
    return out.otherwise(OTHER_CURRENCY)


def last_amount(line: Column) -> Column:
    """Struct (token, amount) of a line's last amount; null without one."""
    token = F.try_element_at(numbers.tokens(line), F.lit(-1))
    value = numbers.last_token(token)
    return F.when(value.isNotNull(), F.struct(token.alias("token"), value.alias("amount")))


def totals(c: Column, perceived: Column | None = None) -> Column:
    """Struct (subtotal, vat, perceptions, total) of a text; ``perceived`` is the sum of its perceptions where they are known one by one. Null where nothing is found."""
    found = amount_near(c, PERCEPTION_LABELS, 0, 2)
    return F.struct(
        F.coalesce(amount_near(c, SUBTOTAL_LABELS[0], 0, 3), amount_near(c, SUBTOTAL_LABELS[1])).alias("subtotal"),
        F.coalesce(vat_sum(c), *[amount_near(c, x) for x in VAT_LABELS]).alias("vat"),
        (found if perceived is None else F.coalesce(perceived, found)).alias("perceptions"),
        amount_near(c, TOTAL_LABELS).alias("total"),
    )


def vat_sum(c: Column, e: Column | None = None) -> Column:
    """Sum of the taxes between the net and the total: for each rate's line its last amount above 100, or that of the next four lines; null if none."""
    def in_lines(e):
        def ends(e):
            starts = lambda x, a, b: F.startswith(x, F.lit(a)) | F.startswith(x, F.lit(b))
            last = F.array_max(F.transform(e["up"], lambda x, i: F.when(starts(x, "IMPORTE", "TOTAL") & x.rlike(r"^IMPORTE TOTAL\b|^TOTAL A PAGAR\b|^IMPORTE A PAGAR\b"), i)))
            return let(last, lambda last: F.struct(last.alias("last"), F.array_max(F.transform(e["up"], lambda x, i: F.when((i < last) & starts(x, "IMPORTE", "SUBTOTAL") & x.rlike(r"^IMPORTE NETO GRAVADO\b|^SUBTOTAL\s*:\s*$"), i))).alias("first")))

        def between(at):
            start = F.coalesce(at["first"], F.lit(0))
            n = F.greatest(F.coalesce(at["last"], F.size(e["ls"]) - 1) - start + 1, F.lit(0))
            return F.struct(F.slice(e["ls"], start + 1, n).alias("ls"), F.slice(e["up"], start + 1, n).alias("up"))

        def in_block(b):
            def tax(up, i):
                stop = F.array_position(F.transform(F.slice(b["up"], i + 2, 4), lambda x: x.rlike(r"\b(?:VTO|VIO|CAE|TOTAL|SUBTOTAL|PERC)\b")), True)
                own = F.slice(b["ls"], i + 1, F.when(stop > 0, stop.cast("int")).otherwise(5))
                return F.when(up.rlike(r"\bI\W*V\W*A\W*\d+(?:[.,]\d+)?\s*%?"), F.get(F.filter(F.transform(own, line_amount), lambda a: a > 100), F.lit(0)))

            def added(found):
                return F.when(F.size(found) > 0, F.aggregate(found, F.lit(0).cast(numbers.MONEY), lambda a, x: (a + x).cast(numbers.MONEY)))

            return let(F.filter(F.transform(b["up"], tax), lambda x: x.isNotNull()), added)

        return let(let(ends(e), between), in_block)

    return in_text(c, e, in_lines).cast(numbers.MONEY)


def jurisdiction(c: Column) -> Column:
    """The province named in a text: aliases first, then the longest name; empty if none."""
    from docfacts.operators.items import PROVINCES

    flat = F.regexp_replace(fold(c), "[^A-Z0-9]+", " ")
    out = F
    for alias, place in (*PLACE_ALIASES, *((p, p) for p in sorted(PROVINCES, key=len, reverse=True))):
        out = out.when(flat.rlike(rf"\b{alias}\b"), "CABA" if place in ("CABA", "CAPITAL FEDERAL") else place.title())
    return out.otherwise("")


def jurisdiction_code(place: Column) -> Column:
    from docfacts.operators.items import PROVINCES

    out = F
    for p, code in PROVINCES.items():
        out = out.when(fold(place) == p, code)
    return out.otherwise("")


def provider_name(c: Column, aliases: list[str] | None = None, key: str = "", e: Column | None = None) -> Column:
    """An alias in the text; a labelled name before the customer's part; the best of the issuer's first twenty lines; the key in words."""
    known = [F.when(c.rlike(rf"(?iu)\b\Q{a}\E\b"), a) for a in aliases or [] if a.strip()]

    def own_lines(e):
        ls = e["ls"]
        marked = F.transform(ls, lambda x, i: text.has(F.get(e["up"], i), *CUSTOMER_WORDS) & x.rlike(I + CUSTOMER_MARKS))
        return let(F.array_position(marked, True).cast("int"), lambda cut: F.when(cut > 1, F.slice(ls, F.lit(1), cut - 1)).otherwise(F.slice(ls, 1, 20)))

    def in_lines(own):
        label = F.regexp_extract(F.array_join(own, "\n"), I + NAME_LABEL, 1)
        label = F.btrim(F.get(F.split(label, r"(?iu)\s{2,}|CUIT|DNI|IVA|CONDICIÓN|CONDICION|DOMICILIO"), F.lit(0)), F.lit(" :-"))

        def scored(line, i):
            x = F.btrim(F.btrim(line), F.lit("•·-–—"))
            return let(F.struct(x.alias("x"), F.upper(x).alias("up"), i.alias("i")), rated)

        def rated(s):
            x, up, i = s["x"], s["up"], s["i"]
            skip = F.lit(False)
            for w in SKIP_WORDS:
                skip = skip | F.contains(up, F.lit(w))
            letters = F.length(F.regexp_replace(x, r"[^\p{L}]", ""))
            words = F.size(F.split(F.btrim(x), r"\s+"))
            points = F.when(up.rlike(COMPANY), 30).otherwise(0) + F.when(up == x, 8).otherwise(0) + F.when(words.between(2, 8), 4).otherwise(0) - F.when(x.rlike(r"\d"), 4).otherwise(0) - F.when(up.rlike("(?u)" + STREET), 6).otherwise(0)
            return F.when(~skip & (letters >= 4) & ~up.rlike(r"^[0-9./\-]+$"), F.struct(points.alias("points"), (-i).alias("early"), x.alias("name")))

        best = F.array_max(F.transform(F.slice(own, 1, 20), scored))
        return F.coalesce(let(label, lambda x: F.when(F.length(F.regexp_replace(x, r"[^\p{L}]", "")) >= 4, x)), let(best, lambda x: F.when(x["points"] > 0, x["name"])))

    spoken = key.replace("_", " ").title() if key and key != "UNKNOWN" else ""
    return F.coalesce(*known, in_text(c, e, lambda e: let(own_lines(e), in_lines)), F.lit(spoken))


def provider_key(c: Column) -> Column:
    """A key of at most 80 characters from the provider's name, id or label; UNKNOWN."""
    def slug(x):
        return F.substring(F.regexp_replace(F.upper(F.btrim(x)), r"[^0-9A-ZÁÉÍÓÚÑÜa-záéíóúñü]+", "_"), 1, 80)

    labelled = [blank_to_null(F.regexp_extract(c, I + p, 1)) for p in (r"C\.?U\.?I\.?T\.?[:\s]+([0-9\-]{10,13})", r"Raz[oó]n Social[:\s]+(.+)")]
    return F.coalesce(slug(F.coalesce(blank_to_null(provider_name(c)), *labelled)), F.lit("UNKNOWN"))


def record(c: Column, has_items: Column | None = None) -> Column:
    """Struct of all fields with a confidence: 0.35 and 0.08 for each of seven fields found, 0.05 with items, 0.95 at most."""
    def raw(e):
        return F.struct(
            provider_name(c, e=e).alias("provider_name"), tax_id(c).alias("tax_id"), number(c).alias("number"), issue_date(c, e).alias("issued"), kind(c, e).alias("kind"),
            amount_near(c, SUBTOTAL, e=e, words=SUBTOTAL_WORDS).cast(numbers.MONEY).alias("subtotal"), vat_sum(c, e).alias("vat"), amount_near(c, TOTAL, e=e, words=TOTAL_WORDS).cast(numbers.MONEY).alias("total"),
        )

    def rated(r):
        seven = [F.coalesce(r[n].cast("string"), F.lit("")) != "" for n in ("provider_name", "tax_id", "number", "issued", "subtotal", "vat", "total")]
        points = sum((s.cast("int") for s in seven[1:]), seven[0].cast("int")) * 0.08 + 0.35
        if has_items is not None:
            points = points + F.when(has_items, 0.05).otherwise(0.0)
        return F.struct(*[r[n].alias(n) for n in ("provider_name", "tax_id", "number", "issued", "kind", "subtotal", "vat", "total")], F.round(F.least(points, F.lit(0.95)), 2).alias("confidence"))

    return let(let(searched(c), raw), rated)

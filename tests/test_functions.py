from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from docfacts.functions import dates, extract, ids, numbers, payload, text
from docfacts.operators import classify


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "c string").select(fn(F.col("c")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("1.234,56", D("1234.56")), ("1,234.56", D("1234.56")), ("ARS $ 12,5", D("12.50")), ("1234", D("1234.00")), ("12.5", D("12.50")), ("-3,10", D("-3.10")), ("1.234.567", None), ("abc", None), ("", None),
        (None, None), ("1.005", D("1.00")), ("0,125", D("0.12")), ("1.234.567,89", D("1234567.89")),
    ],
)
def test_amounts(spark, raw, want):
    assert one(spark, raw, numbers.amount) == want
    assert one(spark, raw, numbers.amount_or_zero) == (want or D("0.00"))


@pytest.mark.parametrize(("raw", "want"), [("5/3/24", "2024-03-05"), ("05-03-2024", "2024-03-05"), ("31/02/2024", None), ("el 2024-13-99", "2024-13-99"), ("nada", None), (None, None), ("1/1/202", None)])
def test_dates(spark, raw, want):
    assert one(spark, raw, dates.iso_date) == want


def test_more_numbers_and_dates(spark):
    assert one(spark, "total 3 de 1.234,50", numbers.last_token) == D("1234.50")
    assert one(spark, "1,2345", numbers.quantity) == D("1.2345")
    assert one(spark, "123456", numbers.bare_money) == D("1234.56")
    assert one(spark, "2024-05-06T07:08:09-03:00", dates.wall_clock) == "2024-05-06 07:08:09"
    assert one(spark, "05/06/24", dates.any_format) == "05/06/2024" and one(spark, "otra", dates.any_format) == "otra"
    assert one(spark, "x", lambda c: numbers.tail_of(F.lit("30.50").cast("decimal(18,2)"), F.lit("1230.50").cast("decimal(18,2)")))


def test_ids(spark):
    assert one(spark, "30500010912", ids.valid_tax_id) is True
    assert one(spark, "30500010913", ids.valid_tax_id) is False and one(spark, None, ids.valid_tax_id) is False
    assert one(spark, "30500010912", ids.format_tax_id) == "30-50001091-2" and one(spark, "12", ids.format_tax_id) == "12"
    assert one(spark, "123456", lambda c: ids.code_text(c, 4)) == "123456" and one(spark, "7", lambda c: ids.code_text(c, 4)) == "0007"
    assert [one(spark, c, ids.letter_of_code) for c in ("1", "8", "011", "51", "203", "99", "")] == ["A", "B", "C", "M", "A", None, None]
    assert one(spark, "nota credito", lambda c: ids.code_of_type(c, F.lit("b"))) == "008"
    assert one(spark, "PES", ids.currency) == "ARS" and one(spark, "DOL", ids.currency) == "USD" and one(spark, "pesos", ids.currency) == ""
    assert one(spark, "0f0f0f0f", lambda c: ids.hamming(c, F.lit("0f0f0f00"), 8)) == 4 and one(spark, "", lambda c: ids.hamming(c, F.lit("0f0f0f00"), 8)) == 9999


def test_text(spark):
    assert one(spark, "Razón  Social\f\n\n\n\nx ", text.tidy) == "Razón Social\n\nx"
    assert one(spark, "Árbol ñandú, S.R.L.", text.accounting_key) == "ARBOL NANDU S R L"
    assert one(spark, "uno dos tres", lambda c: text.cut_words(c, 8)) == "uno dos…" and one(spark, "uno", lambda c: text.cut_words(c, 8)) == "uno"
    assert one(spark, "RazÃ³n", lambda c: text.repair_encoding(c)) == "Razón" and one(spark, "RazÃ³n", text.mojibake_score) == 1
    assert one(spark, "a\nTotal: 5 \nTotal: 6", lambda c: text.first_line(c, "(?i)total")) == "Total: 5"
    assert one(spark, "Ação", lambda c: text.fold_all(c)) == "ACAO" and one(spark, "$ 1.234,5", text.only_numbers) is True
    assert one(spark, "a b/c", text.slug) == "a-b-c"


def test_payload(spark):
    data = F.struct(F.lit("30500010912").alias("cuit"), F.lit(3).alias("ptoVta"))
    url = spark.range(1).select(F.concat(F.lit("https://x.example/?p="), payload.encode(data))).first()[0]
    assert one(spark, url, payload.decode)["cuit"] == "30500010912"
    assert one(spark, "https://x.example/?q=1", payload.decode) is None and one(spark, "!!", payload.decode) is None and one(spark, None, payload.decode) is None


ISSUER, OTHER = "30-50001091-2", "20-12345678-6"


def test_issuer_wins_over_customer_printed_first(spark):
    body = f"Cliente: Juan\nCUIT: {OTHER}\n\n\n\nEmisor: ACME\nCUIT: {ISSUER}\nFACTURA A"
    assert one(spark, OTHER.replace("-", ""), ids.valid_tax_id) and one(spark, body, extract.issuer_tax_id) == ISSUER


def test_phone_is_no_number(spark):
    body = "Tel: 4444 - 12345678\n" + "relleno de texto\n" * 20 + "Factura A N° 0003-00001234"
    got = spark.createDataFrame([(body,)], "c string").select(extract.number(F.col("c")).alias("n")).first()["n"]
    assert (got["point"], got["number"]) == ("0003", "00001234")


def test_five_digit_point_stays(spark):
    body = "Punto de Venta: 00018 Comp. Nro: 123456"
    got = spark.createDataFrame([(body,), (None,), ("nada",)], "c string").select(extract.number(F.col("c")).alias("n")).collect()
    assert [tuple(r["n"]) for r in got] == [("00018", "00123456"), ("", ""), ("", "")]


def test_total_is_not_a_subtotal_or_tax_total(spark):
    body = "Subtotal: $ 1.000,00\nTotal IVA: $ 210,00\nTotal a pagar: $ 1.210,00\nCantidad Total 3"
    assert one(spark, body, extract.total) == D("1210.00") and one(spark, body, extract.total_evidence) == "Total a pagar: $ 1.210,00"
    assert one(spark, "nada", extract.total) == 0 and one(spark, None, extract.total) == 0


def test_rate_without_amount_gives_none(spark):
    assert one(spark, "IVA 21%\nTotal: 100,00", lambda c: extract.vat_text(c, "21")) is None


def test_cents_are_no_rate(spark):
    assert one(spark, "IVA 21%: 1.027,27\nTotal: 5.919,27", lambda c: extract.vat_text(c, "27")) is None


def test_general_rate_label(spark):
    assert one(spark, "Tasa Gral.: 2.100,00", lambda c: extract.vat(c, "21")) == D("2100.00")


def test_tax_table(spark):
    body = "Base Imp.  Tasa IVA  Imp. IVA  Subtotal\n1.000,00  21,00 %  210,00  1.210,00\n"
    row = one(spark, body, extract.tax_row)
    assert (row["base"], row["tax"], row["subtotal"]) == (D("1000.00"), D("210.00"), D("1210.00"))
    assert one(spark, body, extract.net_text) == "1000.00"


def test_glued_subtotal(spark):
    assert one(spark, "EXENTO 0,00Subt.: 70.431,65", extract.net_text) == "70431.65"


def test_codes_and_kinds(spark):
    assert one(spark, "FACTURA\nCod. 6", extract.document_code) == "006"
    assert one(spark, "Nota de Crédito B", extract.kind) == "NOTA_CREDITO" and one(spark, "algo", extract.kind) == "FACTURA"
    assert one(spark, "NOTA DE DÉBITO", extract.legacy_kind) == "NOTA_DEBITO" and one(spark, "b factura", extract.legacy_kind) == "FACTURA_B"
    assert one(spark, "CAE N°: 12345678901234", extract.authorisation) == "12345678901234"
    assert one(spark, "Fecha Vto CAE: 01/02/2024", extract.expiry_date) == "2024-02-01"
    assert one(spark, "Precio en dólares", extract.currency) == "USD"
    assert one(spark, "Percepción IVA: 12,00", extract.vat_perception) == "12.00" and one(spark, "Otros tributos: 7", extract.other_taxes) == "7.00"


def test_names_and_addresses(spark):
    body = "Razón Social: La Firma SA   Fecha: 1/1/2024\nDomicilio Comercial: Calle 1   CUIT: 1\nPiso 2\nSr.(s): [9] Cliente Uno  x\nIVA: Exento   CUIT: 20-12345678-6"
    assert one(spark, body, extract.business_name) == "La Firma SA" and one(spark, body, extract.address) == "Calle 1, Piso 2"
    who = one(spark, body, extract.customer)
    assert (who["name"], who["tax_id"], who["condition"]) == ("Cliente Uno", "20-12345678-6", "Exento")
    assert one(spark, "  Descripción ", extract.bad_name) is True and one(spark, "ACME SA", extract.bad_name) is False


def test_labels_of_profiles(spark):
    assert one(spark, "Neto: $ 1.234,50", lambda c: extract.after_label(c, "Neto")) == D("1234.50")
    assert one(spark, "Vence: 3/4/25", lambda c: extract.after_label(c, "Vence", "date")) == "03/04/2025"
    assert one(spark, "Moneda: Pesos", lambda c: extract.after_label(c, "Moneda", "text")) == "Pesos"


def test_classes(spark):
    got = one(spark, "  Remito N 1 entrega", classify.classified)
    assert (got["tipo_documento"], got["confianza"], got["requiere_revision"]) == ("REMITO", 80, True)
    assert one(spark, "", classify.by_words) == "ILEGIBLE" and one(spark, None, classify.by_words) == "ILEGIBLE" and one(spark, "hola", classify.by_words) == "OTRO_DOCUMENTO"
    assert one(spark, "x", lambda c: classify.classified(c, F.lit("3")))["tipo_documento"] == "NOTA_CREDITO" and one(spark, "x", lambda c: classify.classified(c, F.lit("")))["confianza"] == 90


def test_second_extractor(spark):
    from docfacts.functions import advanced

    body = "Distribuidora Sur S.R.L.\nAv. Siempreviva 1\nCUIT: 30-50001091-2\nFactura A\nFecha de Emisión:\n\n05/06/2024\nCliente: Otro\nImporte Neto Gravado: 1.000,00\nIVA 21%\n210,00\nImporte Total: 1.210,00\nVto: 09/09/2024"
    got = one(spark, body, advanced.record)
    assert (got["provider_name"], got["tax_id"], got["issued"], got["kind"]) == ("Distribuidora Sur S.R.L.", "30500010912", "05/06/2024", "FACTURA")
    assert (got["subtotal"], got["vat"], got["total"], got["number"]) == (D("1000.00"), D("210.00"), D("1210.00"), "") and got["confidence"] == 0.83
    assert one(spark, body, advanced.provider_key) == "DISTRIBUIDORA_SUR_S_R_L_" and one(spark, "1 2", advanced.provider_key) == "UNKNOWN"
    assert one(spark, body, lambda c: advanced.provider_name(c, ["sur"])) == "sur"
    assert one(spark, "Comprobante: 3-45", advanced.number) == "00003-00000045" and one(spark, "NOTA DE CRÉDITO A", advanced.kind) == "NOTA_CREDITO"
    assert one(spark, "IB. Mnes", advanced.jurisdiction) == "Misiones" and one(spark, None, lambda c: advanced.record(c)["total"]) is None
    assert one(spark, " a1 \n\n b2", text.lines) == ["a1", "b2"]


def test_tax_id_with_a_wrong_check_digit_is_a_last_resort(spark):
    assert one(spark, "CUIT: 30-00000000-0", ids.first_tax_id) == "30-00000000-0"
    assert one(spark, f"CUIT: 30-00000000-0 y {ISSUER}", ids.first_tax_id) == ISSUER
    assert one(spark, "nada", ids.first_tax_id) == ""


def test_letter_at_the_end_of_a_line(spark):
    assert one(spark, "ACME SRL  A\nDireccion x\nFACTURA", extract.letter) == "A"
    assert one(spark, "relleno\n" * 120 + "ACME SRL  A\nDireccion x\nFACTURA", extract.letter) is None
    assert one(spark, "ACME SRL  A\n" + "relleno\n" * 30 + "FACTURA", extract.letter) is None


def test_total_with_a_table_heading_far_away(spark):
    heading = "Cantidad Descripción Precio Unit.\n"
    assert one(spark, heading + "x\n" * 140 + "IVA TOTAL\n1.234,50", extract.total) == D("1234.50")
    assert one(spark, heading + "IVA TOTAL\n1.234,50", extract.total) == D("0.00")
    assert one(spark, "IVA TOTAL\n1.234,50\nIVA TOTAL\n99,00 CAE 7000", extract.total) == D("1234.50")


def test_number_with_the_best_surroundings(spark):
    def number(body):
        n = spark.createDataFrame([(body,)], "c string").select(extract.number(F.col("c")).alias("n")).first()["n"]
        return n["point"], n["number"]

    far = "abc def\n" * 140
    assert number("0001-00000001\n" + far + "FACTURA 0002-00000002") == ("0002", "00000002")
    assert number(far + "0001-00000001") == ("", "")  # late, and nothing speaks for it
    assert number("FACTURA 0001-00000001 FACTURA 0002-00000002") == ("0001", "00000001")
    assert number("VENDEDOR 0001-00000001") == ("", "")


def test_small_functions(spark):
    from docfacts.functions import advanced

    assert [one(spark, x, advanced.currency) for x in ("Total EUR 5", "dolares", "euros", "nada")] == ["EUR", "USD", "EUR", "ARS"]
    assert [one(spark, x, ids.content_type) for x in ("a/b.PDF", "x.json", "x", None)] == ["application/pdf", "application/json; charset=utf-8", "application/octet-stream", "application/octet-stream"]
    assert [one(spark, x, numbers.flag) for x in ("true", "false", None)] == [1, 0, 0]
    assert one(spark, "Cod. 006 FACTURA", extract.letter_by_code) == "B" and one(spark, "nada", extract.letter_by_code) is None
    assert tuple(one(spark, "a 1.234,50 b 7,25", advanced.last_amount)) == ("7,25", D("7.25")) and one(spark, "nada", advanced.last_amount) is None
    body = "Importe Neto Gravado: 1000,00\nIVA: 210,00\nPercepcion IIBB: 30,00\nTotal: 1240,00"
    assert tuple(one(spark, body, advanced.totals)) == (D("1000.00"), D("210.00"), D("30.00"), D("1240.00")) and tuple(one(spark, "nada", advanced.totals)) == (None,) * 4


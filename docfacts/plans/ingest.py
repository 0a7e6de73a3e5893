"""Ingestion, items and sinks over rendered texts and mails made from tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docfacts.functions import numbers
from docfacts.operators import items, staging
from docfacts.plans.catalogue import query
from docfacts.sources import landing, sinks
from docfacts.sources.tables import table

ITEMS_SQL = """
WITH l AS (SELECT l_orderkey AS id, CAST(l_quantity AS DECIMAL(15,4)) AS q, CAST(l_extendedprice AS DECIMAL(15,2)) AS s FROM lineitem)
SELECT id, count(*) AS n, CAST(sum(q) AS DECIMAL(25,4)) AS quantity, CAST(sum(s) AS DECIMAL(25,2)) AS total FROM l GROUP BY id
"""


@query("line_items_udf", ITEMS_SQL)
def q_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's lines rendered as a table, parsed, and summed again."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    money = F.col("l_extendedprice").cast("decimal(15,2)")
    row = F.concat(F.lit("Articulo pieza  "), F.format_string("%d", F.col("l_quantity").cast("long")), F.lit("  "), numbers.argentine(F.round(money / F.col("l_quantity"), 2)), F.lit("  "), numbers.argentine(money))
    body = F.concat(F.lit("FACTURA A\nDescripción  Cantidad  Precio Unit.  Subtotal\n"), F.array_join(F.collect_list(row), "\n"), F.lit("\nTotal: 1,00"))
    docs = l.groupBy(F.col("l_orderkey").alias("id")).agg(body.alias("body"))
    rows = docs.select("id", F.explode(items.line_items("body")).alias("i"))
    return rows.groupBy("id").agg(F.count("*").alias("n"), F.sum("i.cantidad").cast("decimal(25,4)").alias("quantity"), F.sum("i.subtotal").cast("decimal(25,2)").alias("total"))


@query("line_items_stacked", ITEMS_SQL)
def q_stacked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's lines rendered as a table with one value a line, parsed, cleaned, and summed again."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    money = F.col("l_extendedprice").cast("decimal(15,2)")
    cells = F.concat_ws("\n", F.lit("Tornillo largo"), F.format_string("%d", F.col("l_quantity").cast("long")), F.lit("kg"), numbers.argentine(F.round(money / F.col("l_quantity"), 2)), numbers.argentine(money))
    body = F.concat(F.lit("FACTURA A\nProducto / Servicio\nCantidad\nU. medida\nPrecio Unit.\nSubtotal\n"), F.array_join(F.collect_list(cells), "\n"), F.lit("\nImporte Total: $ 1,00"))
    docs = l.groupBy(F.col("l_orderkey").alias("id")).agg(body.alias("body"))
    rows = docs.select("id", F.explode(items.cleaned(items.line_items("body"))).alias("i"))
    return rows.groupBy("id").agg(F.count("*").alias("n"), F.sum("i.cantidad").cast("decimal(25,4)").alias("quantity"), F.sum("i.subtotal").cast("decimal(25,2)").alias("total"))


PERCEPTION_SQL = """
SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'MISIONES' WHEN 1 THEN 'SANTA FE' ELSE 'CORDOBA' END AS jurisdiccion, CASE o_orderkey % 3 WHEN 0 THEN '914' WHEN 1 THEN '921' ELSE '904' END AS codjur,
       CAST(o_totalprice AS DECIMAL(15,2)) AS importe FROM orders
"""


@query("perceptions_udf", PERCEPTION_SQL)
def q_perceptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    place = F.when(k % 3 == 0, "Misiones").when(k % 3 == 1, "Santa Fe").otherwise("Córdoba")
    body = F.concat(F.lit("Ingresos Brutos: 901-123456-7\nPercepción IIBB "), place, F.lit("\n$ "), numbers.argentine(F.col("o_totalprice").cast("decimal(15,2)")))
    rows = table(spark, sf_dir, "orders").select(k.alias("id"), F.explode(items.perceptions(body)).alias("p"))
    return rows.select("id", "p.jurisdiccion", "p.codjur", "p.importe")


MAIL_SQL = """
WITH m AS (SELECT c_custkey AS uid, CASE c_custkey % 3 WHEN 0 THEN 'Ana <ana@good.example>' WHEN 1 THEN 'x@bad.example' ELSE 'solo@one.example' END AS sender FROM customer),
a AS (SELECT uid, sender, unnest(['doc.PDF', 'note.txt', 'scan.jpg']) AS name FROM m)
SELECT uid, sender, name FROM a WHERE NOT contains(sender, 'bad') AND name <> 'note.txt'
"""


@query("mail_attachments", MAIL_SQL)
def q_mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    sender = F.when(k % 3 == 0, "Ana <ana@good.example>").when(k % 3 == 1, "x@bad.example").otherwise("solo@one.example")
    parts = F.array(*[F.struct(F.lit(n).alias("name"), F.lit("").alias("mime"), F.lit(None).cast("binary").alias("content")) for n in ("doc.PDF", "note.txt", "scan.jpg")])
    mails = table(spark, sf_dir, "customer").select(k.alias("uid"), sender.alias("sender"), F.lit("s").alias("subject"), parts.alias("attachments"))
    return landing.attachments(mails, ["@good.example", "solo@one.example"]).select("uid", "sender", "name")


XML_SQL = """
SELECT o_orderkey AS id, '<factura><numero>' || o_orderkey || '</numero><nota />' || '<pago>' || CASE WHEN o_orderstatus = 'F' THEN 'true' ELSE 'false' END || '</pago><items><item>' || o_orderpriority || '</item><item>a &amp; b</item></items></factura>' AS xml FROM orders
"""


@query("xml_sink", XML_SQL)
def q_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("numero"), F.lit(None).cast("string").alias("nota"), (F.col("o_orderstatus") == "F").alias("pago"), F.array("o_orderpriority", F.lit("a & b")).alias("items")
    )
    return rows.select(F.col("numero").alias("id"), sinks.document_xml(rows).alias("xml"))


USABLE_SQL = """
WITH l AS (SELECT l_orderkey AS id, l_linenumber AS n, CASE WHEN l_linenumber % 2 = 0 THEN NULL ELSE l_extendedprice END AS sub, l_quantity AS q FROM lineitem)
SELECT id, count(*) AS lines, sum(CASE WHEN sub > 0 THEN 1 ELSE 0 END)::BIGINT AS given FROM l WHERE coalesce(sub, q * 2) > 0 GROUP BY id
"""


@query("usable_lines", USABLE_SQL)
def q_usable(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    item = F.struct(F.lit("").alias("descripcion"), F.col("l_quantity").alias("cantidad"), F.lit(2.0).alias("precio_unitario"), F.when(F.col("l_linenumber") % 2 != 0, F.col("l_extendedprice")).alias("subtotal"))
    docs = l.groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(item).alias("items"))
    given = F.size(F.filter("items", lambda x: x["subtotal"] > 0))
    return docs.select("id", F.size(staging.usable_lines(F.col("items"))).cast("long").alias("lines"), given.cast("long").alias("given"))

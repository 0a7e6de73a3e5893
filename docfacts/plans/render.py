"""Invoice-like texts from orders, so that extraction can be held against the columns they were made of."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docfacts.functions import ids, numbers, payload
from docfacts.sources.tables import spread, table

#: The columns that texts are made of, for DuckDB.
FACTS_SQL = """
b AS (SELECT o_orderkey AS id, o_custkey, CAST(o_totalprice AS DECIMAL(18,2)) AS total, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS issued,
             CASE o_orderstatus WHEN 'O' THEN 'A' WHEN 'F' THEN 'B' ELSE 'C' END AS letter,
             '30' || lpad(CAST(o_custkey AS VARCHAR), 8, '0') AS ten FROM orders),
c AS (SELECT *, 11 - (5*CAST(ten[1] AS INT) + 4*CAST(ten[2] AS INT) + 3*CAST(ten[3] AS INT) + 2*CAST(ten[4] AS INT) + 7*CAST(ten[5] AS INT) + 6*CAST(ten[6] AS INT)
             + 5*CAST(ten[7] AS INT) + 4*CAST(ten[8] AS INT) + 3*CAST(ten[9] AS INT) + 2*CAST(ten[10] AS INT)) % 11 AS r FROM b),
f AS (SELECT id, o_custkey, total, issued, letter, lpad(CAST(o_custkey % 9000 + 1 AS VARCHAR), 4, '0') AS point, lpad(CAST(id AS VARCHAR), 8, '0') AS number,
             ten[1:2] || '-' || ten[3:10] || '-' || CAST(CASE r WHEN 11 THEN 0 WHEN 10 THEN 9 ELSE r END AS VARCHAR) AS tax_id,
             CAST(floor(total * 100 / 121) AS DECIMAL(18,0)) AS units FROM c),
facts AS (SELECT *, CAST(units AS DECIMAL(18,2)) AS net, CAST(total - units AS DECIMAL(18,2)) AS vat FROM f)
"""


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per order: what its document says."""
    o = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderstatus"))
    total = F.col("o_totalprice").cast("decimal(18,2)")
    ten = F.concat(F.lit("30"), F.lpad(F.col("o_custkey").cast("string"), 8, "0"))
    rows = o.select(
        F.col("o_orderkey").alias("id"), "o_custkey", total.alias("total"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("issued"),
        F.when(F.col("o_orderstatus") == "O", "A").when(F.col("o_orderstatus") == "F", "B").otherwise("C").alias("letter"),
        F.lpad((F.col("o_custkey") % 9000 + 1).cast("string"), 4, "0").alias("point"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0").alias("number"),
        ids.format_tax_id(F.concat(ten, ids.check_digit(ten).cast("string"))).alias("tax_id"), F.floor(total * 100 / 121).cast("decimal(18,2)").alias("net"),
    )
    return rows.withColumn("vat", (F.col("total") - F.col("net")).cast("decimal(18,2)"))


def documents(spark: SparkSession, sf_dir: str, us: bool = False) -> DataFrame:
    """The facts with their text (``body``) and payload URL (``url``); amounts in US notation if ``us``."""
    money = numbers.grouped if us else numbers.argentine
    day = F.date_format(F.to_date("issued"), "dd/MM/yyyy")
    parts = [
        F.lit("ACME SERVICIOS SRL"),
        F.concat(F.lit("FACTURA "), F.col("letter")),
        F.concat(F.lit("Punto de Venta: "), F.col("point"), F.lit("  Comp. Nro: "), F.col("number")),
        F.concat(F.lit("Fecha de Emisión: "), day),
        F.concat(F.lit("Emisor CUIT: "), F.col("tax_id")),
        F.lit("Condición frente al IVA: Responsable Inscripto"),
        F.lit("Cliente: 20-00000000-1"),
        F.lit("Cantidad Descripción Precio Unit. Total 12"),
        F.concat(F.lit("Importe Neto Gravado: $ "), money("net")),
        F.concat(F.lit("IVA 21%: $ "), money("vat")),
        F.concat(F.lit("Importe Total: $ "), money("total")),
        F.concat(F.lit("CAE N°: "), F.lpad(F.col("id").cast("string"), 14, "7")),
        F.concat(F.lit("Fecha Vto. CAE: "), day),
    ]
    data = F.struct(
        F.lit(1).alias("ver"), F.col("issued").alias("fecha"), F.regexp_replace("tax_id", "-", "").alias("cuit"), F.col("point").cast("int").alias("ptoVta"),
        F.when(F.col("letter") == "A", 1).when(F.col("letter") == "B", 6).otherwise(11).alias("tipoCmp"), F.col("id").alias("nroCmp"), F.col("total").cast("string").alias("importe"),
        F.lit("PES").alias("moneda"), F.lpad(F.col("id").cast("string"), 14, "7").alias("codAut"),
    )
    return facts(spark, sf_dir).select("*", F.concat_ws("\n", *parts).alias("body"), F.concat(F.lit("https://example.org/fe/qr/?p="), payload.encode(data)).alias("url"))

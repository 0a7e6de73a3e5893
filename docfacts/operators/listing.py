"""The query surface over processed documents: filters, pages, summaries, lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docfacts.sources.shared import saved

DEFAULT_PAGE, LARGEST_PAGE = 50, 200
SECRET = "(?i)password|passwd|secret|token|api_?key|authorization|credential"


def clamp(limit, default: int = DEFAULT_PAGE, most: int = LARGEST_PAGE) -> int:
    """1 to ``most``; what is no number is the default."""
    try:
        return max(1, min(most, int(limit)))
    except (TypeError, ValueError):
        return default


def with_position(df: DataFrame, path: str, name: str = "id") -> DataFrame:
    """Position of each row by descending path (null last), before any filter; rows of one path follow each other by their contents.

    Paths are counted and range-partitioned, and a partition's first position comes
    from the counts of the partitions before, so no task sees all rows; each path's
    rows are numbered where they meet their path's first position.
    """
    named = {"_path": F.coalesce(path, F.lit("")), "_none": F.col(path).isNull()}
    order = [F.asc("_none"), F.desc("_path")]
    counts = df.select(*[c.alias(n) for n, c in named.items()]).groupBy("_path", "_none").agg(F.count("*").alias("_n"))
    spread = counts.repartitionByRange(*order).sortWithinPartitions(*order)
    local = saved(spread.select("_path", "_none", "_n", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_r")))
    before = (Window.unboundedPreceding, -1)
    sums = local.groupBy("_p").agg(F.sum("_n").alias("_sum"))
    starts = sums.select("_p", F.coalesce(F.sum("_sum").over(Window.orderBy("_p").rowsBetween(*before)), F.lit(0)).alias("_s"))
    upto = F.coalesce(F.sum("_n").over(Window.partitionBy("_p").orderBy("_r").rowsBetween(*before)), F.lit(0))
    places = local.withColumn("_upto", upto).join(starts, "_p").select("_path", "_none", (F.col("_upto") + F.col("_s")).alias("_first"))
    inside = F.row_number().over(Window.partitionBy("_path", "_none").orderBy(F.xxhash64(*[F.col(c) for c in df.columns])))
    rows = df.withColumns(named).withColumn("_in", inside).join(places, ["_path", "_none"])
    return rows.select(*df.columns, (F.col("_first") + F.col("_in")).cast("long").alias(name))


def matching(
    status: str | None = None, review: str | None = None, tax_id: str | None = None, name: str | None = None, since: str | None = None, until: str | None = None, document: str | None = None,
    kind: str | None = None, free: str | None = None, columns: dict[str, str] | None = None, haystack: tuple[str, ...] = (),
) -> Column:
    """All filters that are given, as one predicate that the optimiser can push to the scan."""
    c = {k: F.col(v) for k, v in (columns or {}).items()}
    found = F.lit(True)
    if status:
        found = found & (c["status"] == status)
    if review is not None:
        found = found & (c["review"] == (review.lower() in ("true", "1", "yes")))
    if tax_id:
        found = found & F.contains(c["tax_id"], F.lit(tax_id))
    if name:
        found = found & F.contains(F.lower(c["name"]), F.lit(name.lower()))
    if since:
        found = found & (F.coalesce(c["date"], F.lit("")) >= since)
    if until:
        found = found & (F.coalesce(c["date"], F.lit("")) <= until)
    if document:
        found = found & (F.lower(c["document"]) == document.lower())
    if kind:
        found = found & (F.lower(c["kind"]) == kind.lower())
    if free:
        found = found & F.contains(F.lower(F.concat_ws(" ", *haystack)), F.lit(free.lower()))
    return found


# The schema of a stored document's listed parts, and where each listed column comes from, with what stands for a missing one.
DOCUMENT = """fecha_proceso string, estado string, origen struct<sha256: string, tipo: string, archivo_original: string, email: struct<`from`: string, subject: string>,
clasificacion_documento: struct<tipo_documento: string>>, comprobante struct<tipo: string, letra: string, punto_venta: string, numero: string, fecha_emision: string, moneda: string, cae: string>,
emisor struct<razon_social: string, cuit: string>, importes struct<total: decimal(18,2)>, validaciones struct<requiere_revision: boolean, observaciones: array<string>>,
diagnostico struct<recomendacion: string, clasificacion_documento: struct<tipo_documento: string>>, extraccion_enriquecida struct<perfil_aplicado: string>, qr_afip map<string, string>"""
LISTED = {
    "sha256": "origen.sha256", "fecha_proceso": "fecha_proceso", "estado": "estado", "source_type": "origen.tipo", "archivo_original": "origen.archivo_original", "email_from": "origen.email.from",
    "email_subject": "origen.email.subject", "emisor_razon_social": "emisor.razon_social", "emisor_cuit": "emisor.cuit", "tipo_comprobante": "comprobante.tipo", "letra": "comprobante.letra",
    "punto_venta": "comprobante.punto_venta", "numero_comprobante": "comprobante.numero", "fecha_emision": "comprobante.fecha_emision", "moneda": "comprobante.moneda", "cae": "comprobante.cae",
    "diagnostico_recomendacion": "diagnostico.recomendacion", "perfil_proveedor_aplicado": "extraccion_enriquecida.perfil_aplicado",
}


def list_items(df: DataFrame, path: str, document: str) -> DataFrame:
    """The listed columns of stored documents (JSON texts); one that can't be read has no row. Missing texts are empty, a missing total is 0."""
    rows = df.select(F.col(path).alias("json_file"), F.from_json(document, DOCUMENT).alias("_d")).filter(F.get_json_object(F.col(document), "$").isNotNull())
    d = F.col("_d")

    def at(where: str) -> Column:
        out = d
        for part in where.split("."):
            out = out[part]
        return out

    return rows.select(
        "json_file", *[F.coalesce(at(where), F.lit("")).alias(name) for name, where in LISTED.items()],
        F.coalesce(d["validaciones"]["requiere_revision"], F.lit(False)).alias("requiere_revision"), F.coalesce(d["importes"]["total"], F.lit(0).cast("decimal(18,2)")).alias("total"),
        F.coalesce(at("origen.clasificacion_documento.tipo_documento"), at("diagnostico.clasificacion_documento.tipo_documento"), F.lit("")).alias("clasificacion_documento"),
        (F.coalesce(F.size("_d.qr_afip"), F.lit(0)) > 0).alias("qr_detectado"), F.coalesce(d["validaciones"]["observaciones"], F.array().cast("array<string>")).alias("fallas_principales"),
        F.regexp_replace("json_file", r"\.json$", ".xml").alias("xml_file"), F.regexp_replace("json_file", r"\.json$", ".ready").alias("ready_file"),
    )


def page(df: DataFrame, order: list[Column], limit=DEFAULT_PAGE, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(max(0, offset)).limit(clamp(limit))


def top_counts(df: DataFrame, key: Column, seq: str, k: int) -> DataFrame:
    """The k commonest keys; among equals the one seen first."""
    return df.groupBy(key.alias("key")).agg(F.count("*").alias("n"), F.min(seq).alias("first_seen")).orderBy(F.desc("n"), "first_seen").limit(k)


def newest(df: DataFrame, state: str, name: str, k: int) -> DataFrame:
    """The k rows of each state with the greatest names."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(state).orderBy(F.desc(name)))).filter(F.col("rank") <= k)


def redacted(m: Column, pattern: str = SECRET) -> Column:
    """A map with the values of secret keys blanked."""
    return F.transform_values(m, lambda k, v: F.when(k.rlike(pattern), "***").otherwise(v))


def by_prefix(df: DataFrame, column: str, prefix: str) -> DataFrame:
    if not (6 <= len(prefix) <= 64) or any(ch not in "0123456789abcdef" for ch in prefix.lower()):
        raise ValueError("a hash prefix has 6 to 64 hexadecimal digits")
    return df.filter(F.col(column).startswith(prefix.lower()))

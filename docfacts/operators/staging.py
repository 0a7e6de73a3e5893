"""Staging star: latest-wins and replace-children merges, views and corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: list[str], keep: tuple[str, ...] = (), greatest: tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``old`` overwritten by those of ``new`` on ``key``: ``keep`` columns stay as they were, ``greatest`` ones take the larger value.

    Columns that ``old`` doesn't have are dropped, columns that ``new`` lacks stay. One shuffle of both sides on the key.
    """
    shared = [c for c in old.columns if c in new.columns and c not in key]
    o, n = old.alias("o"), new.select(*key, *shared, F.lit(True).alias("_new")).alias("n")
    cond = F.lit(True)
    for k in key:
        cond = cond & F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}"))
    both = o.withColumn("_old", F.lit(True)).alias("o").join(n, cond, "full")

    def merged(c: str) -> Column:
        a, b = F.col(f"o.{c}"), F.col(f"n.{c}")
        if c in key:
            return F.when(F.col("_old"), a).otherwise(b)
        if c not in shared:
            return a
        if c in keep:
            return F.when(F.col("_old"), a).otherwise(b)
        if c in greatest:
            return F.greatest(a, b)
        return F.when(F.col("_new"), b).otherwise(a)

    return both.select(*[merged(c).alias(c) for c in old.columns])


def latest(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_rn = 1").drop("_rn")


def replace_children(old: DataFrame, new: DataFrame, parent: str, frozen: DataFrame | None = None) -> DataFrame:
    """Children of every parent in ``new`` replaced, except of ``frozen`` parents (already imported)."""
    if frozen is not None:
        new = new.join(frozen.select(parent), parent, "left_anti")
    return old.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new.select(old.columns))


def number_lines(df: DataFrame, parent: str, order: list[Column], name: str = "linea") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(parent).orderBy(*order)))


def document_text(letter: str, point: str, number: str) -> Column:
    blank = F.lit("")
    return F.concat(F.coalesce(letter, blank), F.lit(" "), F.coalesce(point, blank), F.lit("-"), F.coalesce(number, blank))


def pending_view(headers: DataFrame, mails: DataFrame, columns: list[str]) -> DataFrame:
    """Headers not yet imported with their mail; a header with several attachments stays several rows."""
    rows = headers.filter("importada = 0").withColumn("comprobante", document_text("letra", "punto_venta", "numero"))
    return rows.join(mails, rows["id"] == mails["factura_id"], "left").select(*columns)


def detail_view(details: DataFrame, headers: DataFrame, detail_columns: list[str], header_columns: list[str]) -> DataFrame:
    h = headers.select(F.col("id").alias("_h"), *header_columns)
    return details.join(h, details["factura_id"] == h["_h"]).select(*detail_columns, *header_columns)


def overlay(df: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Columns of ``changes`` put over those of ``df`` where the key is in ``changes``."""
    names = [c for c in changes.columns if c != key]
    c = changes.select(F.col(key).alias("_k"), *[F.col(n).alias(f"_{n}") for n in names], F.lit(True).alias("_hit"))
    joined = df.join(c, df[key] == F.col("_k"), "left")
    return joined.select(*[F.when(F.col("_hit"), F.col(f"_{n}")).otherwise(F.col(n)).alias(n) if n in names else F.col(n) for n in df.columns])


def usable_lines(items: Column) -> Column:
    """Items with a positive subtotal, or with quantity and price to make one."""
    def full(x):
        made = F.when(x["subtotal"] > 0, x["subtotal"]).otherwise(F.round(x["cantidad"] * x["precio_unitario"], 2))
        return F.struct(x["descripcion"].alias("descripcion"), x["cantidad"].alias("cantidad"), x["precio_unitario"].alias("precio_unitario"), made.alias("subtotal"))

    return F.filter(F.transform(items, full), lambda x: x["subtotal"] > 0)


#: Characters of a line's description.
DESCRIPTION = 255


def _first_text(*texts: Column) -> Column:
    return F.substring(F.coalesce(*[F.nullif(F.btrim(x), F.lit("")) for x in texts], F.lit("")), 1, DESCRIPTION)


def reference_text(items: Column, advanced_items: Column, issuer: Column) -> Column:
    """What an account is looked up by: the first item's description, even an empty one; else the second extractor's; else the issuer's name."""
    first = F.when(F.size(items) > 0, F.coalesce(F.get(items, F.lit(0))["descripcion"], F.lit("")))
    other = F.when(F.size(advanced_items) > 0, F.coalesce(F.get(advanced_items, F.lit(0))["descripcion"], F.lit("")))
    return F.substring(F.coalesce(first, other, issuer, F.lit("")), 1, DESCRIPTION)


def reference_amount(items: Column, *amounts: Column) -> Column:
    """The first item's subtotal, else the first of ``amounts``, that is above 0; else 0."""
    first = F.when(F.size(items) > 0, F.get(items, F.lit(0))["subtotal"])
    return F.coalesce(*[F.when(x > 0, x) for x in (first, *amounts)], F.lit(0)).cast("decimal(18,2)")


def with_fallback(items: Column, issuer: Column, account: Column, reference: Column, net: Column, total: Column) -> Column:
    """The usable lines; without any, one line with the issuer's name (else the account's, else the reference text) and the net amount, else the total."""
    usable = usable_lines(items)
    amount = F.coalesce(F.when(net != 0, net), total, F.lit(0)).cast("decimal(15,2)")
    none = F.lit(None).cast("decimal(15,4)")
    line = F.struct(_first_text(issuer, account, reference).alias("descripcion"), none.alias("cantidad"), none.alias("precio_unitario"), amount.alias("subtotal"))
    return F.when(F.size(usable) > 0, usable).otherwise(F.array(line))


def sums(children: DataFrame, parent: str, amount: str) -> DataFrame:
    """(parent, n, total) of each parent's children."""
    return children.groupBy(parent).agg(F.count("*").alias("n"), F.sum(amount).alias("total"))


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n) of each table; an empty one has 0."""
    each = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()]
    out = each[0]
    for df in each[1:]:
        out = out.unionByName(df)
    return out


def inbox(headers: DataFrame) -> list[Column]:
    """The order of pending documents: those to be reviewed first, then by time."""
    return [F.desc("requiere_revision"), F.asc("fecha_proceso")]


def learned(rules: DataFrame, details: DataFrame, headers: DataFrame) -> DataFrame:
    """``rules`` (proveedor, patron, cuenta, confianza, veces_confirmada, origen) after the accounts of confirmed ``details`` (factura_id, patron, cuenta) of ``headers`` (id, proveedor).

    A confirmation makes a rule of full confidence, or gives the rule of its supplier
    and pattern its account and one more confirmation. Of several of one pattern the
    greatest account counts, each of them as a confirmation.
    """
    key = ["proveedor", "patron"]
    said = details.join(headers.select(F.col("id").alias("factura_id"), "proveedor"), "factura_id").groupBy(*key).agg(F.max("cuenta").alias("_cuenta"), F.count("*").alias("_n"))
    cond = rules["proveedor"].eqNullSafe(said["proveedor"]) & rules["patron"].eqNullSafe(said["patron"])
    both = rules.withColumn("_old", F.lit(True)).join(said, cond, "full")
    new = F.col("_n").isNotNull()
    return both.select(
        *[F.when(F.col("_old"), rules[k]).otherwise(said[k]).alias(k) for k in key], F.coalesce("_cuenta", "cuenta").alias("cuenta"), F.when(new, 100).otherwise(F.col("confianza")).alias("confianza"),
        (F.coalesce("veces_confirmada", F.lit(0)) + F.coalesce("_n", F.lit(0))).cast("long").alias("veces_confirmada"), F.when(new, "manual").otherwise(F.col("origen")).alias("origen"),
    )


def events(rows: DataFrame, parent: Column, kind: str, detail: Column, user: str) -> DataFrame:
    """Audit rows of a change, to be appended."""
    return rows.select(parent.alias("factura_id"), F.lit(kind).alias("evento"), detail.alias("detalle"), F.lit(user).alias("usuario"))


def align(df: DataFrame, target: list[str]) -> DataFrame:
    """Only the columns that the target table has."""
    return df.select([c for c in target if c in df.columns])


def ensure_column(df: DataFrame, name: str, kind: str) -> DataFrame:
    return df if name in df.columns else df.withColumn(name, F.lit(None).cast(kind))

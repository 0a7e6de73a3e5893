"""Supplier profiles: which one a document has, and fields filled by its labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docfacts.functions import extract, text
from docfacts.operators import provenance

#: How each field of a profile is read.
READ_AS = dict.fromkeys(("total", "neto_gravado", "iva_21", "iva_105", "iva_27", "percepciones_iibb", "percepciones_iva", "otros_tributos"), "amount") | {
    "cae": "text", "vencimiento_cae": "date", "proveedor_nombre": "text", "moneda": "text",
}
SCHEMA = "proveedores map<string,struct<nombre:string,aliases:array<string>,campos:map<string,array<string>>,tolerancia_total:string>>, aliases_globales map<string,string>"


def load(spark: SparkSession, path: str) -> DataFrame:
    """A profile dictionary as one row of SCHEMA; bad JSON gives nulls."""
    return spark.read.schema(SCHEMA).option("multiLine", True).json(path)


def suppliers(dictionary: DataFrame) -> DataFrame:
    """(tax_id, profile) of a dictionary."""
    return dictionary.select(F.explode("proveedores").alias("tax_id", "profile"))


def global_aliases(dictionary: DataFrame) -> DataFrame:
    return dictionary.select(F.explode("aliases_globales").alias("alias", "tax_id"))


def select_profile(body: Column, qr_id: Column, text_id: Column, aliases: list[tuple[str, str]], own: list[tuple[str, str]], known: list[str]) -> Column:
    """Struct (method, tax_id): by payload id, by text id, by the one global alias in the text, by the one supplier with an alias in it.

    ``known`` are the suppliers with a profile, ``aliases`` (alias, supplier) the
    global ones, ``own`` the suppliers' own: a configuration file, so literals of one
    expression and no join at all. Two hits are ambiguous and select nothing.
    """
    up = F.upper(body)

    def entries(pairs):
        return F.array(*[F.struct(F.lit(a.upper()).alias("alias"), F.lit(t).alias("tax_id")) for a, t in sorted(pairs)]) if pairs else F.array().cast("array<struct<alias:string,tax_id:string>>")

    qr, tx = F.regexp_replace(qr_id, r"\D", ""), F.regexp_replace(text_id, r"\D", "")
    hits = F.filter(entries(aliases), lambda x: F.contains(up, x["alias"]))
    mine = F.array_distinct(F.transform(F.filter(entries(own), lambda x: F.contains(up, x["alias"])), lambda x: x["tax_id"]))
    one = F.get(hits, F.lit(0))["tax_id"]

    def found(method, tax_id):
        return F.struct(F.lit(method).alias("method"), tax_id.cast("string").alias("tax_id"))

    none = F.lit(None)
    return (
        F.when(qr.isin(*known), found("qr_cuit", qr))
        .when(tx.isin(*known), found("text_cuit", tx))
        .when(F.size(hits) > 1, found("alias_ambiguo", none))
        .when(one.isin(*known), found("alias", one))
        .when(F.size(mine) > 1, found("alias_ambiguo", none))
        .when(F.size(mine) == 1, found("alias", F.get(mine, F.lit(0))))
        .otherwise(found("sin_perfil", none))
    )


def filled(field: Column, body: Column, name: str, labels: list[str]) -> Column:
    """A field, or what the first label that hits gives, if the field is empty or less sure than 80."""
    def fresh(label: str) -> Column:
        def made(v: Column) -> Column:
            return F.when(v != "", provenance.field(v, provenance.PROFILE, "perfil_proveedor", f"profile_label_{name}", F.concat(F.lit(f"etiqueta '{label}' -> '"), v, F.lit("'"))))

        return text.let(extract.after_label(body, label, READ_AS[name]).cast("string"), made)

    weak = field["valor"].isNull() | (field["confianza"] < 80)
    return F.coalesce(F.when(weak, F.coalesce(*[fresh(label) for label in labels])), field)

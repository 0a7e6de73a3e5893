"""Where results go: JSON, XML and CSV files, staging tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def xml(value: Column, kind: T.DataType, tag: str) -> Column:
    """XML of a value: struct fields as elements, list entries as ``item``, null as an empty element, floats with two places."""
    opened, closed = f"<{tag}>", f"</{tag}>"
    empty = F.lit(f"<{tag} />")

    def wrap(inner: Column) -> Column:
        return F.concat(F.lit(opened), inner, F.lit(closed))

    if isinstance(kind, T.StructType):
        inner = F.concat(*[xml(value[f.name], f.dataType, f.name) for f in kind.fields]) if kind.fields else F.lit("")
        return F.when(value.isNotNull(), wrap(inner)).otherwise(empty)
    if isinstance(kind, T.ArrayType):
        inner = F.array_join(F.transform(value, lambda x: xml(x, kind.elementType, "item")), "")
        return F.when(F.size(value) > 0, wrap(inner)).otherwise(empty)
    if isinstance(kind, T.BooleanType):
        text = F.when(value, "true").otherwise("false")
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        text = F.format_string("%.2f", value.cast("double"))
    else:
        text = value.cast("string")
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return F.when(value.isNotNull() & (F.coalesce(text, F.lit("")) != ""), wrap(text)).otherwise(empty)


def document_xml(df: DataFrame, tag: str = "factura") -> Column:
    """XML of a whole row."""
    return xml(F.struct(*[F.col(c) for c in df.columns]), df.schema, tag)


def file_name(issued: Column, sha256: Column) -> Column:
    """FACTURA_yyyymmdd_ and the hash's first eight digits."""
    return F.concat(F.lit("FACTURA_"), F.coalesce(F.regexp_replace(issued, "-", ""), F.lit("00000000")), F.lit("_"), F.substring(sha256, 1, 8))


def write_json(df: DataFrame, folder: str, mode: str = "errorifexists") -> None:
    """A folder of JSON lines; Spark's _SUCCESS is written last and marks it as ready."""
    df.write.mode(mode).json(folder)


def write_csv(rows: list[DataFrame], folder: str, mode: str = "errorifexists") -> None:
    """One CSV of reports whose columns differ: all columns, in the order first seen."""
    reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows).write.mode(mode).option("header", True).csv(folder)


def jdbc_options(url: str | None, env: dict[str, str]) -> dict[str, str] | None:
    """Connection options from a URL or from parts; None if neither is there."""
    if url:
        return {"url": url if url.startswith("jdbc:") else f"jdbc:{url}"}
    if not env.get("MYSQL_HOST") or not env.get("MYSQL_DATABASE"):
        return None
    return {"url": f"jdbc:mysql://{env['MYSQL_HOST']}:{env.get('MYSQL_PORT', '3306')}/{env['MYSQL_DATABASE']}", "user": env.get("MYSQL_USER", ""), "password": env.get("MYSQL_PASSWORD", "")}

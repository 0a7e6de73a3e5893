"""Where documents come from: landed files, mail, a queue in folders."""

from __future__ import annotations

from email.header import decode_header

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Suffixes of documents that can be read, and their types.
SUFFIXES = ("pdf", "png", "jpg", "jpeg", "webp", "bmp", "tif", "tiff")
STATES = ("pendientes", "procesados", "errores")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def supported(path: Column) -> Column:
    return suffix(path).isin(*SUFFIXES)


def files(spark: SparkSession, folder: str, pattern: str = "*", stream: bool = False) -> DataFrame:
    """Landed files (path, modificationTime, length, content) with their name and hash; as a stream if asked."""
    reader = spark.readStream if stream else spark.read
    schema = "path string, modificationTime timestamp, length long, content binary"
    rows = (reader.schema(schema) if stream else reader).format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return rows.withColumns({"filename": F.regexp_extract("path", r"([^/]+)$", 1), "sha256": F.sha2("content", 256)}).filter(supported(F.col("path")) | F.lit(pattern != "*"))


def page_of_files(df: DataFrame, offset: int, limit: int) -> DataFrame:
    return df.orderBy("path").offset(offset).limit(limit)


def texts(spark: SparkSession, folder: str) -> DataFrame:
    """A text per file (path, body)."""
    return spark.read.text(folder, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("body"))


@F.pandas_udf(T.StringType())
def header_text(s: pd.Series) -> pd.Series:
    """A mail header with its encoded words decoded."""
    def read(x):
        return None if x is None else "".join(p if isinstance(p, str) else p.decode(c or "utf-8", "replace") for p, c in decode_header(x))

    return s.map(read)


def csv_values(c: Column) -> Column:
    """Comma-separated values, trimmed, lower case, without blanks."""
    return F.filter(F.transform(F.split(c, ","), lambda x: F.lower(F.trim(x))), lambda x: x != "")


def sender_allowed(sender: Column, rules: list[str]) -> Column:
    """No rule allows all; a rule is an address, '@domain' or a bare domain."""
    if not rules:
        return F.lit(True)
    s = F.lower(F.coalesce(F.nullif(F.regexp_extract(sender, r"<([^>]+)>", 1), F.lit("")), F.trim(sender)))
    found = F.lit(False)
    for r in (r.strip().lower() for r in rules):
        found = found | (s.endswith(r) if r.startswith("@") else (s == r) if "@" in r else s.endswith("@" + r))
    return F.coalesce(found, F.lit(False))


def attachments(mails: DataFrame, senders: list[str], suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """A row per wanted attachment of mails (uid, sender, subject, attachments: array<struct<name, mime, content>>)."""
    rows = mails.filter(sender_allowed(F.col("sender"), senders)).select("uid", "sender", "subject", F.explode("attachments").alias("a"))
    return rows.select("uid", "sender", "subject", "a.name", "a.mime", "a.content").filter(suffix(F.col("name")).isin(*suffixes))


#: Characters of a PDF's text from which no other reading is tried.
ENOUGH_TEXT = 40


def text_or_reading(pdf: Column, reading: Column) -> Column:
    """A PDF's own text if there is enough of it, else what was read from its pages."""
    own = F.btrim(F.coalesce(pdf, F.lit("")))
    return F.when(F.length(own) >= ENOUGH_TEXT, own).otherwise(F.coalesce(F.nullif(F.btrim(reading), F.lit("")), own))


def fetched_uid(answer: Column) -> Column:
    """The message number in a mail server's answer; empty without one."""
    return F.coalesce(F.regexp_extract(answer, r"(?i)UID\s+(\d+)", 1), F.lit(""))


def messages_done(results: DataFrame) -> DataFrame:
    """Mails to be marked as read: those of which no attachment failed."""
    return results.groupBy("uid").agg(F.bool_and("ok").alias("ok")).filter("ok").select("uid")


def metadata(fields: dict[str, Column]) -> Column:
    """A map of the fields that aren't blank."""
    entries = [x for k, v in fields.items() for x in (F.lit(k), v.cast("string"))]
    return F.map_filter(F.create_map(*entries), lambda k, v: F.coalesce(F.trim(v), F.lit("")) != "")


def body_of(pdf: Column, ocr: Column) -> Column:
    """Struct (combined, engine) of both texts of a document."""
    p, o = F.btrim(F.coalesce(pdf, F.lit(""))), F.btrim(F.coalesce(ocr, F.lit("")))
    both = (p != "") & (o != "") & (p != o)
    return F.struct(
        F.when(both, F.concat(p, F.lit("\n\n--- OCR ---\n\n"), o)).when(p != "", p).otherwise(o).alias("combined"),
        F.when(both, "pdf_text+ocr").when(p != "", "pdf_text").when(o != "", "ocr").otherwise("none").alias("engine"),
    )


def best_reading(candidates: Column) -> Column:
    """Of readings (score, text) the best, the first of equals."""
    return F.array_max(F.transform(candidates, lambda x, i: F.struct(x["score"].alias("score"), (-i).alias("first"), x["text"].alias("text"))))["text"]


def reading_quality(c: Column) -> Column:
    """How much a text looks like a well-read invoice: length, labels, valid ids, less its noise."""
    from docfacts.functions import ids

    def worth(pattern, points):
        return F.when(c.rlike("(?iu)" + pattern), points).otherwise(0)

    found = F.filter(F.transform(F.regexp_extract_all(c, F.lit(r"(\b\d{2}[- ]?\d{8}[- ]?\d\b)")), ids.digits), ids.valid_tax_id)
    noise = F.size(F.regexp_extract_all(c, F.lit(r"([^\p{L}\p{N}\s.,:;$%/()#&'\"+*º°-])")))
    return (
        F.least(F.floor(F.length(c) / 80), F.lit(40)) + worth(r"\bFACTURA\b", 15) + worth(r"\d{4,5}\s*-\s*\d{8}", 15) + worth(r"\bC\.?A\.?E\b", 10) + worth(r"\bTOTAL\b.*\d", 10)
        + worth(r"SUB\s*TOTAL.*\d", 8) + worth(r"C\.?U\.?I\.?T", 8) + 12 * F.size(found) + worth(r"CANTIDAD|DESCRIPCI[OÓ]N", 8) - F.floor(noise / 6)
    ).cast("int")

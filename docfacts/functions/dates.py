"""Dates in documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docfacts.functions.text import blank_to_null, let

DAY = r"\b(\d{1,2})[/-](\d{1,2})[/-](\d{2,4})\b"


def iso_date(c: Column) -> Column:
    """The first ISO date as it is; else the first day/month/year, two-digit years from 2000; null if there is none or it is no date."""
    def own(parts):
        d, m, y = (F.get(parts, F.lit(i)) for i in range(3))
        year = F.when(F.length(y) == 2, F.concat(F.lit("20"), y)).when(F.length(y) == 4, y)
        return F.date_format(F.try_to_date(F.concat(year, F.lit("-"), F.lpad(m, 2, "0"), F.lit("-"), F.lpad(d, 2, "0")), "yyyy-MM-dd"), "yyyy-MM-dd")

    found = [blank_to_null(F.regexp_extract(c, p, 0)) for p in (r"\b\d{4}-\d{2}-\d{2}\b", DAY)]
    return F.coalesce(found[0], let(F.split(found[1], "[/-]"), own))


def any_format(c: Column) -> Column:
    """Day/month/year of four or two digits, or ISO, as day/month/year; other text as it is."""
    t = F.btrim(c)
    good = [F.when(t.rlike(rx), F.date_format(F.try_to_date(t, f), "dd/MM/yyyy")) for rx, f in ((r"^\d{2}/\d{2}/\d{4}$", "dd/MM/yyyy"), (r"^\d{2}/\d{2}/\d{2}$", "dd/MM/yy"), (r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"))]
    return F.coalesce(*good, t)


def token(c: Column) -> Column:
    """The first strict day/month/year or ISO date of a text, else empty."""
    return F.regexp_extract(c, r"(\b\d{2}/\d{2}/\d{4}\b|\b\d{4}-\d{2}-\d{2}\b)", 1)


def wall_clock(c: Column) -> Column:
    """Date and time of an ISO stamp without its offset."""
    t = F.regexp_extract(c, r"^(\d{4}-\d{2}-\d{2})[T ](\d{2}:\d{2}:\d{2})", 0)
    return F.nullif(F.translate(t, "T", " "), F.lit(""))

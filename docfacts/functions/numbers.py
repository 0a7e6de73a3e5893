"""Amounts in Argentine (1.234,56) and US (1,234.56) notation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docfacts.functions.text import let

#: Fixed value: an amount token; optional sign, grouped or plain digits, optional decimals.
AMOUNT = r"[-+]?(?:\d{1,3}(?:[.,]\d{3})+|\d+)(?:[.,]\d+)?"
MONEY = "decimal(18,2)"


def _dotted(raw: Column) -> Column:
    """Digits with a decimal point: of two kinds of separators the later is decimal, a lone comma is decimal, lone dots are."""
    comma, dot = F.contains(raw, F.lit(",")), F.contains(raw, F.lit("."))
    comma_last = F.instr(F.reverse(raw), ",") < F.instr(F.reverse(raw), ".")
    argentine = F.translate(F.translate(raw, ".", ""), ",", ".")
    return F.when(comma & dot & ~comma_last, F.translate(raw, ",", "")).when(comma, argentine).otherwise(raw)


def amount(c: Column) -> Column:
    """Decimal with two places, half to even; null if there is no number."""
    raw = F.regexp_replace(c.cast("string"), r"[^0-9,.\-]", "")
    return F.bround(let(raw, _dotted).try_cast("decimal(38,10)"), 2).cast(MONEY)


def amount_or_zero(c: Column) -> Column:
    return F.coalesce(amount(c), F.lit(0).cast(MONEY))


def amount_if_given(c: Column) -> Column:
    """Null for null or blank, else the amount or zero."""
    return F.when(c.cast("string") != "", amount_or_zero(c))


def money_text(c: Column) -> Column:
    """Two-place text of an amount; null if none."""
    return amount(c).cast("string")


def tokens(c: Column) -> Column:
    """All amount tokens of a text."""
    return F.regexp_extract_all(c, F.lit(f"({AMOUNT})"))


def last_token(c: Column) -> Column:
    """The last number of a text; with a decimal comma dots group, without one commas do."""
    def spelled(t):
        return F.when(t.rlike(r",\d{1,2}$"), F.translate(F.translate(t, ".", ""), ",", ".")).otherwise(F.translate(t, ",", ""))

    t = F.try_element_at(F.regexp_extract_all(c, F.lit(r"([-+]?[0-9][0-9.,]*)")), F.lit(-1))
    return let(F.regexp_replace(t, "[.,]+$", ""), spelled).try_cast("decimal(38,10)")


def quantity(c: Column) -> Column:
    """A quantity with up to four decimals after a comma or a point."""
    t = F.btrim(c)
    return F.when(t.rlike(r"^\d+,\d{1,4}$"), F.translate(t, ",", ".").try_cast("decimal(15,4)")).otherwise(F.coalesce(t.try_cast("decimal(15,4)"), last_token(c).try_cast("decimal(15,4)")))


def bare_money(c: Column) -> Column:
    """Six or more bare digits lost their decimal mark: the last two are cents."""
    t = F.btrim(c)
    return F.when(t.rlike(r"^\d{6,}$"), (t.try_cast("decimal(36,2)") / 100).cast("decimal(18,2)")).otherwise(amount(c))


def grouped(c: Column) -> Column:
    """1,234.50"""
    return F.format_number(c, 2)


def argentine(c: Column) -> Column:
    """1.234,50"""
    return F.translate(F.format_number(c, 2), ",.", ".,")


def tail_of(small: Column, large: Column) -> Column:
    """Same cents, and the larger amount's digits end with the smaller one's: a fragment of it."""
    def cents(c):
        return F.translate(c.cast(MONEY).cast("string"), ".", "")

    return (small < large) & F.endswith(cents(large), cents(small))


def flag(c: Column) -> Column:
    """1 for true, 0 for false or null."""
    return F.coalesce(c.cast("boolean"), F.lit(False)).cast("int")

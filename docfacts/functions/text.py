"""Text normalisers as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Marks of text that was decoded with the wrong table.
MOJIBAKE_MARKS = ("Ã", "Â", "â€", "�", "ï¿½")
ACCENTED, _PLAIN = "ÁÉÍÓÚÜÑÇÀÈÌÒÙÂÊÎÔÛÄËÏÖáéíóúüñçàèìòùâêîôûäëïö", "AEIOUUNCAEIOUAEIOUAEIOaeiouuncaeiouaeiouaeio"


def let(value: Column, then) -> Column:
    """``then`` of a value that is computed once, however often ``then`` uses it (inside lambdas, too)."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def blank_to_null(c: Column) -> Column:
    return let(c, lambda x: F.when(x != "", x))


def mojibake_score(c: Column) -> Column:
    """Number of wrong-table marks; null for null."""
    return sum(((F.length(c) - F.length(F.replace(c, F.lit(m), F.lit("")))) / len(m) for m in MOJIBAKE_MARKS[1:]), (F.length(c) - F.length(F.replace(c, F.lit(MOJIBAKE_MARKS[0]), F.lit("")))) / 1).cast("int")


def _repair(value: str | None) -> str:
    def marks(s: str) -> int:
        return sum(s.count(m) for m in MOJIBAKE_MARKS)

    ways = [value or ""]
    if marks(ways[0]):
        for table in ("latin-1", "cp1252"):
            try:
                ways.append(ways[0].encode(table).decode("utf-8"))
            except UnicodeError:
                continue
    return unicodedata.normalize("NFC", min(ways, key=marks))


@F.pandas_udf(T.StringType())
def repair_encoding(s: pd.Series) -> pd.Series:
    """Undo a wrong decoding if that lowers the number of its marks, then compose (NFC); null becomes the empty text."""
    return s.map(_repair, na_action=None)


@F.pandas_udf(T.StringType())
def fold_all(s: pd.Series) -> pd.Series:
    """Upper case without any combining mark (NFKD)."""
    return s.map(lambda x: None if x is None else "".join(ch for ch in unicodedata.normalize("NFKD", x) if not unicodedata.combining(ch)).upper())


def fold(c: Column) -> Column:
    """Upper case without the accents of western European letters; stays in the JVM."""
    return F.upper(F.translate(c, ACCENTED, _PLAIN))


def accounting_key(c: Column) -> Column:
    """Folded text with every run of other characters than A-Z and 0-9 as one space."""
    return F.btrim(F.regexp_replace(fold(F.coalesce(c, F.lit(""))), "[^A-Z0-9]+", " "))


def tidy(c: Column) -> Column:
    """Form feeds as line ends, runs of blanks as one, at most one empty line, no space at the ends."""
    c = F.replace(c, F.lit("\f"), F.lit("\n"))
    c = F.regexp_replace(F.regexp_replace(c, "[ \t]+", " "), "\n{3,}", "\n\n")
    return F.btrim(c, F.lit(" \t\r\n\f\x0b"))


def has(up: Column, *words: str) -> Column:
    """A folded text holds one of some words in capitals: a cheap test before a costly pattern that can't match without. Words with I or K are no test, for caseless patterns take two more letters as those."""
    out = F.contains(up, F.lit(words[0]))
    for w in words[1:]:
        out = out | F.contains(up, F.lit(w))
    return out


def lines(c: Column) -> Column:
    """Trimmed lines of a tidy text that are not blank."""
    single = F.regexp_replace(F.coalesce(c, F.lit("")), "\t[ \t]*| [ \t]+", " ")
    parts = F.transform(F.split(single, r"\R"), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != "")


def raw_lines(c: Column) -> Column:
    return F.split(F.coalesce(c, F.lit("")), r"\R")


def folded_lines(c: Column) -> Column:
    """Lines in upper case without accents: what several searches of one text share."""
    return raw_lines(fold(F.coalesce(c, F.lit(""))))


def caseless(c: Column) -> Column:
    """Folded text in which all that caseless patterns take for a letter A-Z is that capital, so that any word tests it (see ``has``)."""
    return F.replace(F.replace(fold(c), F.lit("İ"), F.lit("I")), F.lit("\u212a"), F.lit("K"))


def cut_words(c: Column, most: int = 80) -> Column:
    """Text with single spaces, cut after a whole word to at most ``most`` characters, with an ellipsis if cut."""
    clean = F.btrim(F.regexp_replace(c, r"\s+", " "))
    head = F.substring(clean, 1, most)
    whole = F.when(F.contains(head, F.lit(" ")), F.regexp_replace(head, " [^ ]*$", "")).otherwise(head)
    return F.when(F.length(clean) <= most, clean).otherwise(F.concat(whole, F.lit("…")))


def slug(c: Column) -> Column:
    return F.lower(F.translate(c, " /", "--"))


def only_numbers(c: Column) -> Column:
    """A line of digits, separators, blanks and currency signs with at least one digit."""
    return c.rlike(r"^[$ 0-9.,\-]+$") & c.rlike("[0-9]")


def first_line(c: Column, pattern: str) -> Column:
    """The first line that matches, trimmed; else the match over lines, at most 180 characters; else empty."""
    hits = F.filter(raw_lines(c), lambda x: x.rlike(pattern))
    whole = F.substring(F.btrim(F.regexp_replace(F.regexp_extract(c, f"(?s){pattern}", 0), r"\s+", " ")), 1, 180)
    return F.when(F.size(hits) > 0, F.btrim(F.get(hits, F.lit(0)))).otherwise(F.coalesce(whole, F.lit("")))

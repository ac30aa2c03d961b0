"""Scalar column functions over symbols, dates and company names."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_ticker(t: Column) -> Column:
    """Class separators as the price vendor writes them: ``BRK.B`` -> ``BRK-B``."""
    return F.replace(t, F.lit("."), F.lit("-"))


def canonical_symbol(t: Column) -> Column:
    """Stripped, upper-cased and normalised symbol."""
    return normalize_ticker(F.upper(F.trim(t)))


def clean_cell(t: Column) -> Column:
    """A table cell without footnote marks such as ``[1]``; no-break blanks become blanks."""
    return F.trim(F.replace(F.regexp_replace(t, r"\[[^\]]*\]", ""), F.lit(" "), F.lit(" ")))


def iso_date(t: Column) -> Column:
    """The first ``yyyy-mm-dd`` of a text, or null."""
    found = F.regexp_extract(t, r"(\d{4}-\d{2}-\d{2})", 1)
    return F.try_to_date(F.nullif(found, F.lit("")), "yyyy-MM-dd")


def change_date(t: Column) -> Column:
    """A change log's date: full or short month name, month and year only, or ISO; else null."""
    text = F.trim(t)
    formats = ("MMMM d, yyyy", "MMM d, yyyy", "MMMM yyyy")
    # two-digit days with a leading zero parse under the same patterns once the zero is gone
    bare = F.regexp_replace(text, r"\b0(\d),", "$1,")
    return F.coalesce(*(F.try_to_date(bare, f) for f in formats), iso_date(text))


def to_date(value: str | date | datetime | None) -> date | None:
    """A Python date from an ISO string, date or datetime; None passes."""
    if value is None or (isinstance(value, date) and not isinstance(value, datetime)):
        return value
    return value.date() if isinstance(value, datetime) else date.fromisoformat(str(value)[:10])


def name_tokens(name: Column) -> Column:
    """Distinct lower-case alphanumeric tokens of a company name."""
    return F.array_distinct(F.filter(F.split(F.lower(name), r"[^a-z0-9]+"), lambda t: t != ""))


def same_company(a: Column, b: Column) -> Column:
    """True if the smaller token set lies inside the larger and has a token of four letters or more.

    Of equally large sets the first counts as the smaller; null or empty names never match.
    """
    ta, tb = name_tokens(a), name_tokens(b)
    small = F.when(F.size(ta) <= F.size(tb), ta).otherwise(tb)
    large = F.when(F.size(ta) <= F.size(tb), tb).otherwise(ta)
    inside = (F.size(F.array_except(small, large)) == 0) & (F.size(small) > 0)
    return F.coalesce(inside & F.exists(small, lambda t: F.length(t) >= 4), F.lit(False))

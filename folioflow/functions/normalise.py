"""Values of a reply made canonical: dates, exact decimals, amounts, tags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import trim_space

#: The only forms that are kept.
DATE_FORM = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"
DECIMAL_FORM = r"\A-?[0-9]+(\.[0-9]+)?\z"
CURRENCY_FORM = r"\A[A-Z]{3}\z"


def parsed_date(x: Column) -> Column:
    """A calendar day written YYYY-MM-DD, else null; nothing is guessed."""
    return F.when(x.rlike(DATE_FORM), F.try_to_date(x, "yyyy-MM-dd"))


def is_decimal(x: Column) -> Column:
    return F.coalesce(x.rlike(DECIMAL_FORM), F.lit(False))


def is_currency(x: Column) -> Column:
    return F.coalesce(x.rlike(CURRENCY_FORM), F.lit(False))


def amount_and_currency(amount: Column, currency: Column) -> tuple[Column, Column]:
    """Both as they are written, if both are valid, else neither."""
    a, c = trim_space(amount), trim_space(currency)
    both = is_decimal(a) & is_currency(c)
    return F.when(both, a), F.when(both, c)


def normalised_tags(tags: Column) -> Column:
    """Lower case, trimmed, no blanks, each once in the order given; null gives none."""
    clean = F.transform(tags, lambda t: F.lower(trim_space(F.coalesce(t, F.lit("")))))
    return F.coalesce(F.array_distinct(F.filter(clean, lambda t: t != "")), F.array().cast("array<string>"))


def date_prefix(date: Column) -> Column:
    return F.coalesce(F.date_format(date, "yyyy-MM-dd"), F.lit(""))


def date_part(date: Column, part: str) -> Column:
    """Zero-padded year, month or day; empty without a date."""
    return F.coalesce(F.date_format(date, {"year": "yyyy", "month": "MM", "day": "dd"}[part]), F.lit(""))


def sorted_tags(tags: Column) -> Column:
    return F.array_sort(tags)


def type_allowed(kind: Column, types: Sequence[str]) -> Column:
    return kind.isin(*types) if types else F.lit(True)


def first_foreign_tag(tags: Column, known: Sequence[str]) -> Column:
    """The first tag outside a bounded vocabulary, null if there is none."""
    if not known:
        return F.lit(None).cast("string")
    return F.get(F.filter(tags, lambda t: ~t.isin(*known)), F.lit(0))

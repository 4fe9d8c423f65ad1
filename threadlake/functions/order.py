"""Orders of text: by collation and by UTF-16 units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def by_locale(text: Column) -> Column:
    """Sort key under ICU's root collation: punctuation, digits, letters; accents
    and then case count only between texts that are else alike, lower case first."""
    return F.collate(text, "UNICODE")


def by_units(text: Column) -> Column:
    """Sort key by UTF-16 units, where characters of two units come before the
    last ones of one unit."""
    return F.encode(text, "UTF-16BE")


def total_order(text: Column) -> Column:
    """By collation, then by units where a collation takes two texts as the same."""
    return F.struct(by_locale(text), by_units(text))

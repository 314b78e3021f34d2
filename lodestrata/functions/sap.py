"""Scalar rules for extracts whose every field is text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def date8(c: Column) -> Column:
    """yyyyMMdd text as a date; null, blank, all zeros and impossible dates are null."""
    return F.when(c.isNull() | c.isin("", "00000000"), F.lit(None).cast("date")).otherwise(F.try_to_date(c, "yyyyMMdd"))


def unpadded(c: Column) -> Column:
    """Without leading zeros; all zeros become the empty string."""
    return F.regexp_replace(c, "^0+", "")


def amount(c: Column, scale: int) -> Column:
    return c.try_cast(f"decimal(18,{scale})")


def flagged(c: Column) -> Column:
    """True if a reason is given."""
    return F.coalesce(F.trim(c) != "", F.lit(False))


def surrogate(*columns: Column) -> Column:
    return F.sha2(F.concat_ws("||", *columns), 256)


def unit_price(net: Column, quantity: Column) -> Column:
    return F.when(quantity > 0, net / quantity).cast("decimal(18,2)")


def date_key(c: Column) -> Column:
    return F.date_format(c, "yyyyMMdd").cast("int")


def fiscal_year(d: Column) -> Column:
    """Years start in July and carry the number of the year they end in."""
    return F.year(d) + F.when(F.month(d) >= 7, 1).otherwise(0)


def fiscal_quarter(d: Column) -> Column:
    return F.pmod(F.quarter(d) + 1, F.lit(4)) + 1


def week_label(d: Column) -> Column:
    return F.concat(F.extract(F.lit("YEAROFWEEK"), d), F.lit("-W"), F.lpad(F.weekofyear(d).cast("string"), 2, "0"))


def mapped(c: Column, pairs: dict, default=None) -> Column:
    """A literal value map with a default."""
    flat = [F.lit(x) for pair in pairs.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*flat), c), F.lit(default))


def reverse_mapped(c: Column, pairs: dict, default=None) -> Column:
    """From values back to keys; of several keys with one value the first counts."""
    back: dict = {}
    for k, v in pairs.items():
        back.setdefault(v, k)
    return mapped(c, back, default)


def fallback(first: Column, second: Column) -> Column:
    """The first text, or else the second, without blanks at either end."""
    return F.trim(F.coalesce(first, second))

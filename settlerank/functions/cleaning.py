"""Lenient parsing and missing-value rules, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from settlerank.fixed_values import MISSING_TOKENS, UNKNOWN

__all__ = ["text_or_null", "to_number", "to_day", "business_id", "profit_of", "known", "zero_filled",
           "positive_or_null", "mbps", "no_nan", "segment_key", "ratio_or_null"]


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def text_or_null(col: Column | str) -> Column:
    """Text with every missing token turned into null."""
    c = _c(col).cast("string")
    return F.when(~c.isin(MISSING_TOKENS), c)


def no_nan(col: Column | str) -> Column:
    """NaN would pass every ``>=`` test in Spark; treat it as missing."""
    return F.when(~F.isnan(_c(col)), _c(col))


def to_number(col: Column | str) -> Column:
    """Lenient number: unparseable text and NaN become null."""
    return no_nan(F.trim(text_or_null(col)).try_cast("double"))


def to_day(col: Column | str) -> Column:
    """Lenient date: unparseable text becomes null."""
    return F.try_to_timestamp(F.trim(text_or_null(col))).cast("date")


def business_id(col: Column | str) -> Column:
    """Drop one trailing ``.0`` that a float round trip leaves on an id."""
    return F.regexp_replace(_c(col).cast("string"), r"\.0$", "")


def profit_of(revenue: Column | str, cost: Column | str) -> Column:
    return _c(revenue) - _c(cost)


def known(col: Column | str) -> Column:
    return F.coalesce(_c(col).cast("string"), F.lit(UNKNOWN))


def zero_filled(col: Column | str) -> Column:
    return F.coalesce(no_nan(_c(col).cast("double")), F.lit(0.0))


def positive_or_null(col: Column | str) -> Column:
    return F.when(_c(col) > 0, _c(col))


def mbps(bits_per_second: Column | str) -> Column:
    return _c(bits_per_second) / F.lit(1e6)


def segment_key(*cols: Column | str) -> Column:
    return F.concat_ws("|", *[known(c) for c in cols])


def ratio_or_null(numerator: Column | str, denominator: Column | str) -> Column:
    """A ratio that is missing, never infinite, when the denominator is zero."""
    return F.try_divide(_c(numerator), _c(denominator))

"""Scoring, labelling and row-quality expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from settlerank.fixed_values import FULL_STREAK_LABEL, SHORT_STREAK_LABEL
from settlerank.functions.cleaning import _c

__all__ = ["has_prefix", "family_token", "mapped", "log1p_floored", "clipped", "capacity_penalty",
           "utilisation_aux", "rounded_money", "rounded_rate", "missing_fields", "missing_count", "streak_label",
           "display_label", "positive_flag", "any_of", "piped", "unpiped", "share_flag", "hash_share"]


def has_prefix(col: Column | str, prefix: str) -> Column:
    return _c(col).startswith(prefix)


def family_token(business: Column | str, name: Column | str, rules: Sequence[tuple[str, str]]) -> Column:
    """The token of the first rule whose substring is in the name, otherwise the id itself."""
    branches = [F.when(_c(name).contains(part), F.lit(token)) for part, token in rules]
    return F.coalesce(*branches, _c(business))


def mapped(col: Column | str, table: Mapping[str, str]) -> Column:
    """Look a value up in a small fixed table and keep it where it has no entry."""
    entries = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(entries, _c(col)), _c(col))


def log1p_floored(col: Column | str) -> Column:
    return F.log1p(F.greatest(_c(col), F.lit(0.0)))


def clipped(col: Column | str, low: float | None = 0.0, high: float | None = None) -> Column:
    c = _c(col)
    out = c if low is None else F.greatest(c, F.lit(float(low)))
    out = out if high is None else F.least(out, F.lit(float(high)))
    return F.when(c.isNotNull(), out)


def capacity_penalty(over: Column | str, capacity: Column | str, missing_over: float = 0.0) -> Column:
    """``min(1, over / capacity)``; zero for an unknown business or a capacity that is not positive.

    A missing ``over`` beside a valid capacity counts as ``missing_over`` (1.0 gives the strict reading).
    """
    share = F.when(_c(over).isNull(), F.lit(float(missing_over))).otherwise(
        F.least(F.lit(1.0), _c(over) / _c(capacity)))
    return F.when(_c(capacity) > 0, share).otherwise(F.lit(0.0))


def utilisation_aux(peak: Column | str, nominal: Column | str) -> Column:
    """Peak over nominal bandwidth, zero where either is unknown, clipped to [0, 2]."""
    util = F.when(_c(nominal) > 0, _c(peak) / _c(nominal))
    return F.least(F.greatest(F.coalesce(util, F.lit(0.0)), F.lit(0.0)), F.lit(2.0))


def rounded_money(col: Column | str) -> Column:
    return F.round(_c(col), 2)


def rounded_rate(col: Column | str) -> Column:
    return F.round(_c(col), 4)


def missing_fields(cols: Sequence[str]) -> Column:
    """Names of the columns that are null in this row, pipe-joined in the given order."""
    names = F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in cols])
    return F.array_join(F.filter(names, lambda n: n.isNotNull()), "|")


def missing_count(cols: Sequence[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.col(c).isNull().cast("int") for c in cols])


def streak_label(days: Column | str) -> Column:
    return F.when(_c(days) >= 7, F.lit(FULL_STREAK_LABEL)).when(
        _c(days) > 0, F.format_string(SHORT_STREAK_LABEL, _c(days).cast("int")))


def display_label(name: Column | str, ident: Column | str, max_len: int | None = None) -> Column:
    """``name id``; with ``max_len`` a longer label is cut and gets an ellipsis."""
    label = F.trim(F.concat_ws(" ", F.coalesce(_c(name), F.lit("")), _c(ident)))
    if max_len is None:
        return label
    return F.when(F.length(label) > max_len, F.concat(F.substring(label, 1, max_len), F.lit("…"))).otherwise(label)


def positive_flag(col: Column | str) -> Column:
    return F.coalesce((_c(col) > 0).cast("int"), F.lit(0))


def any_of(value: Column | str, *cols: Column | str) -> Column:
    """True when the value equals at least one of the columns; nulls never match."""
    return reduce(lambda a, b: a | b, [F.coalesce(_c(c) == _c(value), F.lit(False)) for c in cols])


def piped(array: Column | str) -> Column:
    return F.array_join(_c(array), "|")


def unpiped(text: Column | str) -> Column:
    return F.split(_c(text), r"\|")


def share_flag(condition: Column) -> Column:
    """A flag whose mean is the share of true rows; null counts as false."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def hash_share(share: float, seed: int, *keys: Column | str) -> Column:
    """True for a fixed pseudo-random share of the keys: their md5 prefix lies below the share of its range."""
    limit = format(int(round(share * 65536)), "04x")
    return F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *[_c(k) for k in keys])), 1, 4) < F.lit(limit)

"""Rounding, ratios and times as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import BUCKETS


def tokens_rounded(chars: Column) -> Column:
    """Quarter of the characters, half to even (quarters are exact, so this is exact)."""
    return F.bround(chars / 4, 0).cast("long")


def tokens_floored(chars: Column) -> Column:
    return F.floor(chars / 4).cast("long")


def ratio(a: Column, b: Column, digits: int, otherwise=None) -> Column:
    r = F.round(F.try_divide(a.cast("double"), b.cast("double")), digits)
    return r if otherwise is None else F.coalesce(r, F.lit(otherwise))


def percent(a: Column, b: Column, digits: int = 1, otherwise=None) -> Column:
    r = F.round(F.try_divide(a.cast("double"), b.cast("double")) * 100, digits)
    return r if otherwise is None else F.coalesce(r, F.lit(otherwise))


def size_bucket(tokens: Column) -> Column:
    return reduce(lambda rest, b: F.when(tokens < b[1], b[0]).otherwise(rest), reversed(BUCKETS), F.lit("large"))


def iso_week(day: Column) -> Column:
    return F.concat(F.extract(F.lit("YEAROFWEEK"), day).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"))


def hours_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / 3.6e9


def fact_time(c: Column) -> Column:
    """ISO time; without a zone it is UTC (the session's); bad values are null."""
    return F.try_to_timestamp(F.regexp_replace(c, "Z$", "+00:00"))


def age_label(hours: Column) -> Column:
    return (
        F.when(hours.isNull(), "—")
        .when(hours < 1, "<1h")
        .when(hours < 24, F.concat(F.bround(hours, 0).cast("int").cast("string"), F.lit("h")))
        .otherwise(F.format_string("%.1fd", F.bround(hours / 24, 1)))
    )


def trend_arrow(now: Column, before: Column) -> Column:
    gap = now - before
    return F.when(F.abs(gap) < 0.01, "=").when(gap > 0, "↑").otherwise("↓")

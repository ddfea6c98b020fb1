"""Scalar expressions the operators share. All are built-in functions; none reads the clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def latest_of(history: Column) -> Column:
    """The last element of an array; null for a null or empty one."""
    return F.try_element_at(history, F.lit(-1))


def is_blank(c: Column) -> Column:
    """Null, empty or white space only."""
    return F.coalesce(F.trim(c), F.lit("")) == ""


def epoch_ms_to_ts(c: Column) -> Column:
    return F.timestamp_millis(c)


def partition_keys(ts: Column) -> list[Column]:
    """The partition strings of a timestamp: date (yyMMdd) and time (HHmmss)."""
    return [F.date_format(ts, "yyMMdd").alias("date"), F.date_format(ts, "HHmmss").alias("time")]


def parse_limits(header: Column) -> Column:
    """ "20:1,100:120" as array<struct<limit, period>>; parts that aren't numbers are null."""
    part = lambda p, n: F.trim(F.get(F.split(p, ":"), F.lit(n))).try_cast("long")
    return F.transform(F.split(header, ","), lambda p: F.struct(part(p, 0).alias("limit"), part(p, 1).alias("period")))


def ratio(part: Column, whole: Column, if_zero: float = 0.0) -> Column:
    """part / whole, and if_zero where the whole is 0 (ANSI division would raise)."""
    return F.when(whole == 0, F.lit(if_zero)).otherwise(part.cast("double") / F.when(whole != 0, whole))


def percent(share: Column, digits: int = 2) -> Column:
    """A share as text, such as 12.50%: for reports only, rounded half up."""
    return F.format_string(f"%.{digits}f%%", share * 100)


def as_flag(c: Column) -> Column:
    """Whether a text says true, in any case."""
    return F.lower(F.trim(c)) == "true"


def iso_to_ts(text: Column) -> Column:
    """A time from ISO text, with or without offset; null if it is none."""
    return text.try_cast("timestamp")


def whole_seconds(c: Column) -> Column:
    """A timestamp (or its text) cut to seconds; null if it is none."""
    return F.date_trunc("second", c.try_cast("timestamp"))


def not_null(values: Column) -> Column:
    return F.filter(values, lambda x: x.isNotNull())

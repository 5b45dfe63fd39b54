"""Dates in text, and decay by age."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_date(c: Column) -> Column:
    """The first y-m-d, else the first d/m/y, as yyyy-mm-dd without a calendar check; else the text."""
    ymd, dmy = r"(?U)\b(\d{4})-(\d{1,2})-(\d{1,2})\b", r"(?U)\b(\d{1,2})/(\d{1,2})/(\d{4})\b"
    g = lambda p, k: F.regexp_extract(c, p, k)
    two = lambda x: F.lpad(x, 2, "0")
    return F.when(g(ymd, 1) != "", F.concat_ws("-", g(ymd, 1), two(g(ymd, 2)), two(g(ymd, 3)))).when(g(dmy, 3) != "", F.concat_ws("-", g(dmy, 3), two(g(dmy, 2)), two(g(dmy, 1)))).otherwise(F.trim(c))


def to_day(c: Column) -> Column:
    s = F.substring(c, 1, 10)
    return F.coalesce(*(F.try_to_date(s, f) for f in ("yyyy-M-d", "d/M/yyyy", "yyyy/M/d")))


def decay(day: Column, as_of: Column, half: float = 365.0, missing: float = 0.85) -> Column:
    return F.when(day.isNull(), F.lit(missing)).otherwise(F.exp(-F.greatest(F.datediff(as_of, day), F.lit(0)) / half))


def decayed(score: Column, day: Column, as_of: Column, weight: float = 0.08) -> Column:
    return score * (1 - weight * (1 - decay(day, as_of)))


def month_ranges(start: Column, end: Column) -> Column:
    """(from, to) timestamps of the months between two timestamps; the last ends at end."""
    months = F.sequence(F.trunc(start, "MM").cast("timestamp"), end, F.expr("interval 1 month"))
    return F.transform(months, lambda m: F.struct(m.alias("from"), F.least(F.add_months(m.cast("date"), 1).cast("timestamp") - F.expr("interval 1 second"), end).alias("to")))

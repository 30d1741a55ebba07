"""Dates and periods as columns."""

from __future__ import annotations

import datetime
import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_episode_date(text: Column) -> Column:
    """M/D/YY or M/D/YYYY; two-digit years are 2000 and later; anything else, and dates no calendar has, is null."""
    at = lambda k: F.regexp_extract(text, r"^\s*(\d{1,2})/(\d{1,2})/(\d{4}|\d{2})\s*$", k)
    year = F.when(F.length(at(3)) == 2, F.concat(F.lit("20"), at(3))).otherwise(at(3))
    padded = F.concat_ws("-", year, F.lpad(at(1), 2, "0"), F.lpad(at(2), 2, "0"))
    return F.when(at(1) != "", F.try_to_date(padded, "yyyy-MM-dd"))


def human(date: Column) -> Column:
    """April 8, 2024."""
    return F.date_format(date, "MMMM d, yyyy")


def month_name(month: Column) -> Column:
    return F.when(month.between(1, 12), F.date_format(F.make_date(F.lit(2000), month, F.lit(1)), "MMMM")).otherwise("")


def quarter_ordinal(date: str | Column) -> Column:
    return F.year(date) * 4 + F.quarter(date) - 1


def quarter_key(ordinal: Column) -> Column:
    """YYYY-Qn of a quarter's ordinal."""
    return F.concat(F.floor(ordinal / 4).cast("string"), F.lit("-Q"), (F.pmod(ordinal, F.lit(4)) + 1).cast("string"))


def quarters(first: Column, last: Column) -> Column:
    """All quarter keys from first to last, both included; empty if last is earlier."""
    a, b = quarter_ordinal(first), quarter_ordinal(last)
    return F.when(b >= a, F.transform(F.sequence(a, b), quarter_key)).otherwise(F.array().cast("array<string>"))


def period_bounds(year: int, month: int | None = None) -> tuple[datetime.date, datetime.date]:
    """First and last day of a year or month."""
    if month is None:
        return datetime.date(year, 1, 1), datetime.date(year, 12, 31)
    after = datetime.date(year + month // 12, month % 12 + 1, 1)
    return datetime.date(year, month, 1), after - datetime.timedelta(days=1)


def previous_period(year: int, month: int | None = None) -> tuple[int, int | None]:
    if month is None:
        return year - 1, None
    return (year, month - 1) if month > 1 else (year - 1, 12)


def period_label(year: int, month: int | None = None) -> str:
    return str(year) if month is None else f"{datetime.date(year, month, 1):%B} {year}"


def parse_period_path(path: str) -> tuple[int, int | None] | None:
    """/YYYY or /YYYY/M with a month of 1 to 12; else None."""
    m = re.fullmatch(r"/?(\d{4})(?:/(\d{1,2}))?/?", path)
    if not m or (m[2] and not 1 <= int(m[2]) <= 12):
        return None
    return int(m[1]), int(m[2]) if m[2] else None

"""Fiscal periods (April start) as plain columns: fy INT is the calendar year a year starts in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_MONTHS = ("June", "September", "December", "March")


def fiscal_year(date: Column) -> Column:
    return F.year(F.add_months(date, -3))


def fiscal_quarter(date: Column) -> Column:
    return F.quarter(F.add_months(date, -3))


def normalize_fy(text: Column) -> Column:
    """FY start year from any usual spelling; null when it is not exactly one year boundary."""
    raw = F.regexp_replace(F.regexp_replace(F.upper(F.trim(text)), " ", ""), "[_/]", "-")
    raw = F.regexp_replace(raw, "^FY", "")
    head = F.split_part(raw, F.lit("-"), F.lit(1))
    tail = F.split_part(raw, F.lit("-"), F.lit(2))

    def year(part: Column) -> Column:
        n = part.try_cast("int")
        return F.when(F.length(part) == 4, n).otherwise(n + 2000)

    span = raw.rlike("^[0-9]{4}-([0-9]{2}|[0-9]{4})$") | raw.rlike("^[0-9]{2}-[0-9]{2}$")
    single = raw.rlike("^([0-9]{2}|[0-9]{4})$")
    return F.when(span & (year(tail) == year(head) + 1), year(head)).when(single, year(head) - 1)


def two_digits(year: Column) -> Column:
    return F.lpad((year % 100).cast("string"), 2, "0")


def fy_text(fy: Column) -> Column:
    """FY25-26"""
    return F.concat(F.lit("FY"), two_digits(fy), F.lit("-"), two_digits(fy + 1))


def fy_label(fy: Column) -> Column:
    """2025-26"""
    return F.concat(fy.cast("string"), F.lit("-"), two_digits(fy + 1))


def fy_label_long(fy: Column) -> Column:
    """2025-2026"""
    return F.concat(fy.cast("string"), F.lit("-"), (fy + 1).cast("string"))


def fy_end_label(fy: Column) -> Column:
    """FY26 for the year that starts in 2025."""
    return F.concat(F.lit("FY"), two_digits(fy + 1))


def closing_year(fy: Column, quarter: Column) -> Column:
    """Calendar year a quarter closes in: only the last quarter closes in the next one."""
    return F.when(quarter == 4, fy + 1).otherwise(fy)


def closing_month(quarter: Column) -> Column:
    return F.element_at(F.array(*[F.lit(m) for m in _MONTHS]), quarter)


def closing_date(fy: Column, quarter: Column) -> Column:
    month = F.when(quarter == 4, F.lit(3)).otherwise(quarter * 3 + 3)
    return F.last_day(F.make_date(closing_year(fy, quarter), month, F.lit(1)))


def period_ending_text(fy: Column, quarter: Column) -> Column:
    """31 Dec 2025"""
    return F.date_format(closing_date(fy, quarter), "dd MMM yyyy")


def months_elapsed(quarter: Column) -> Column:
    return quarter * 3


def period_column(fy: Column, quarter: Column) -> Column:
    """FY25-26_Q3"""
    return F.concat(fy_text(fy), F.lit("_Q"), quarter.cast("string"))


def period_label(fy: Column, quarter: Column) -> Column:
    """FY25-26 Q3; the last quarter is the whole year and drops the quarter."""
    return F.when(quarter == 4, fy_text(fy)).otherwise(F.concat(fy_text(fy), F.lit(" Q"), quarter.cast("string")))


def trend_label(fy: Column, quarter: Column) -> Column:
    """Q1 FY27 on a trend axis; FY27 at the last quarter."""
    return F.when(quarter == 4, fy_end_label(fy)).otherwise(
        F.concat(F.lit("Q"), quarter.cast("string"), F.lit(" "), fy_end_label(fy))
    )


def fy_options(date: Column, back: int = 3, forward: int = 1) -> Column:
    """Selectable years around a date, newest first (ARRAY<STRING>)."""
    start = fiscal_year(date)
    return F.transform(F.sequence(start + forward, start - back, F.lit(-1)), fy_text)


def year_sort_key(label: Column) -> Column:
    """First number of a year label; 0 when there is none."""
    return F.coalesce(F.regexp_extract(label, r"(\d+)", 1).try_cast("int"), F.lit(0))


def year_fragments(fy: Column, quarter: Column) -> Column:
    """The two spellings of a closing year: '2025' and '-25'."""
    y = closing_year(fy, quarter)
    return F.array(y.cast("string"), F.concat(F.lit("-"), two_digits(y)))


def states_year(text: Column, year: Column) -> Column:
    """True when a header names the year in full, or as -yy; digits next to it do not count."""
    full = F.regexp_extract_all(text, F.lit(r"(?<![0-9])([0-9]{4})(?![0-9])"), F.lit(1))
    short = F.regexp_extract_all(text, F.lit(r"-([0-9]{2})(?![0-9])"), F.lit(1))
    return F.array_contains(full, year.cast("string")) | F.array_contains(short, two_digits(year))


def period_from_path(path: Column) -> Column:
    """(fy, quarter, run_ts) parsed from .../metrics_FY25-26_Q3_20260131_101500.ext, else null fields."""
    pattern = r"(?i)_(FY\d{2}-\d{2})_Q([1-4])_(\d{8}_\d{6})\.[a-z]+$"
    return F.struct(
        normalize_fy(F.nullif(F.regexp_extract(path, pattern, 1), F.lit(""))).alias("fy"),
        F.regexp_extract(path, pattern, 2).try_cast("int").alias("quarter"),
        F.try_to_timestamp(F.nullif(F.regexp_extract(path, pattern, 3), F.lit("")), F.lit("yyyyMMdd_HHmmss")).alias(
            "run_ts"
        ),
    )

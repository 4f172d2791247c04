"""Period templates of document addresses, Column -> Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .periods import two_digits

_PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)(.*)$"
# fixed values: marks of a signed address, which is never reusable for another period
SIGNED_MARKS = ("sig=", "signature=", "x-amz-", "token=", "se=&", "&se=", "?se=")


def is_signed(url: Column) -> Column:
    low = F.lower(url)
    out = F.lit(False)
    for mark in SIGNED_MARKS:
        out = out | low.contains(mark)
    return out


def _tokens(month: Column, year: Column, quarter: Column) -> list[tuple[Column, str]]:
    """Literal and placeholder, in the order they are replaced: spans before years, months before their short forms."""
    short = F.concat(two_digits(year), F.lit("-"), two_digits(year + 1))
    return [
        (short, "{fy_short}"),
        (F.concat(year.cast("string"), F.lit("-"), two_digits(year + 1)), "{fy_label}"),
        (month, "{month}"),
        (F.substring(month, 1, 3), "{mon}"),
        (year.cast("string"), "{year}"),
        (quarter, "{quarter}"),
    ]


def templatize_url(url: Column, month: Column, year: Column, quarter: Column) -> Column:
    """Address with the period's spellings in its path replaced by placeholders.

    Null for signed addresses and for addresses that name no period.
    """
    path = F.regexp_extract(url, _PARTS, 2)
    out = path
    for literal, placeholder in _tokens(month, year, quarter):
        out = F.regexp_replace(out, F.concat(F.lit("(?i)"), literal), F.lit(placeholder))
    rebuilt = F.concat(F.regexp_extract(url, _PARTS, 1), out, F.regexp_extract(url, _PARTS, 3))
    return F.when(~is_signed(url) & (out != path), rebuilt)


def render_url(template: Column, month: Column, year: Column, quarter: Column) -> Column:
    """Candidate addresses for a period in four casings of its names, distinct, in order."""
    mon = F.substring(month, 1, 3)
    forms = [
        (month, mon, quarter),
        (F.lower(month), F.lower(mon), F.lower(quarter)),
        (F.initcap(month), F.initcap(mon), F.upper(quarter)),
        (F.upper(month), F.upper(mon), F.upper(quarter)),
    ]
    short = F.concat(two_digits(year), F.lit("-"), two_digits(year + 1))
    label = F.concat(year.cast("string"), F.lit("-"), two_digits(year + 1))

    def render(m: Column, a: Column, q: Column) -> Column:
        out = template
        for name, value in (
            ("{month}", m), ("{mon}", a), ("{quarter}", q), ("{year}", year.cast("string")),
            ("{fy_short}", short), ("{fy_label}", label),
        ):
            out = F.replace(out, F.lit(name), value)
        return out

    return F.array_distinct(F.array(*[render(*f) for f in forms]))


def monthly_path(base: str, month: Column, year: Column) -> Column:
    """Address of a mechanically named monthly workbook."""
    return F.concat(
        F.lit(base.rstrip("/") + "/Year_"), year.cast("string"), F.lit("/segment_"), F.lower(month), F.lit("_"),
        year.cast("string"), F.lit(".xlsx"),
    )

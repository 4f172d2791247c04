"""Tables without period headers, and tables with planted faults: what the resolution of columns has to report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .render_filings import (
    SEGMENTS, _row, channel_of, closes_in, figures, filing_quarter, investment_grid, line_facts, period_text, printed)


def _totals(spark, sf_dir, extra: list[str]) -> DataFrame:
    base = figures(line_facts(spark, sf_dir), ["flag"], ["lines", "gross"])
    names = ["lines_cc", "gross_cc", *extra]
    return base.groupBy("shard", "doc", "fy").agg(*[
        F.coalesce(F.sum(F.when(F.col("flag") == f, F.col(n))), F.lit(0)).alias(f"{n}_{f}") for n in names for f in SEGMENTS])


def plain_grid(spark, sf_dir) -> DataFrame:
    """doc, fy, quarter, page, tbl, r, cells: numbers and amounts by segment, no period named, in six layouts.

    0 plain, 1 under a caption, 2 columns the other way round, 3 merged cells and a blank column, 4 without a header row,
    5 figures given in words.
    """
    wide = _totals(spark, sf_dir, [])
    none, layout = F.lit(None).cast("string"), F.col("doc") % 6
    figure = lambda n: F.format_number(F.col(n), 2)

    def arranged(number: Column, amount: Column, label: Column, remark: Column) -> Column:
        usual = F.array(label, remark, number, amount)
        return F.when(layout == 2, F.array(label, remark, amount, number)).when(
            layout == 3, F.array(label, remark, none, number, amount, none)).otherwise(usual)

    head = arranged(F.lit("Number"), F.lit("Amount"), F.lit("Particulars"), F.when(layout == 3, none).otherwise(F.lit("Remarks")))
    caption = F.array(F.lit("FORM NL-41 Office information"), none, none, none)
    lines = []
    for n, (f, name) in enumerate(SEGMENTS.items()):
        told = lambda c: F.when(layout == 5, "see note").otherwise(figure(c))
        lines.append(_row(n + 2, arranged(told(f"lines_cc_{f}"), told(f"gross_cc_{f}"), F.lit(name), F.lit("audited"))))
    empty = F.array().cast("array<struct<r:bigint,cells:array<string>>>")
    rows = F.concat(
        F.when(layout == 1, F.array(_row(0, caption))).otherwise(empty),
        F.when(layout == 4, empty).otherwise(F.array(_row(1, head))), F.array(*lines))
    # row numbers are dense
    rows = F.transform(rows, lambda x, i: F.struct(i.cast("bigint").alias("r"), x["cells"].alias("cells")))
    return wide.select("doc", "fy", filing_quarter().alias("quarter"), F.lit(11).alias("page"), F.lit(0).alias("tbl"), F.inline(rows))


def faulty_grid(spark, sf_dir) -> DataFrame:
    """Four tables a filing (pages 12 to 15: statement, balance, channels, notes); each filing has one fault of five by its number.

    0 notes in words only, 1 statement of the quarter only, 2 balance without years, 3 channels without years, 4 notes with
    a period column outside every group.
    """
    wide = _totals(spark, sf_dir, ["gross_pc"])
    fault, none = F.col("doc") % 5, F.lit(None).cast("string")
    plain = F.lit(0)
    year, before = closes_in(), closes_in() - 1
    sums = {k: sum((F.col(f"gross_{k}_{f}") for f in SEGMENTS), F.lit(0)) for k in ("cc", "pc")}
    cur, prior = (printed(sums[k]) for k in ("cc", "pc"))
    head = lambda y: F.when(fault == 1, period_text(plain, False, y)).otherwise(period_text(plain, True, y))
    statement = [_row(0, [F.lit("Particulars"), head(year), head(before)]), _row(1, [F.lit("Gross Direct Premium"), cur, prior])]
    as_at = lambda y, bare: F.when(fault == 2, bare).otherwise(F.concat(F.lit("As at March 31, "), y.cast("string")))
    balance = [_row(0, [F.lit("Particulars"), as_at(year, F.lit("As at this year's close")), as_at(before, F.lit("As at last year's close"))]),
               _row(1, [F.lit("SHARE CAPITAL"), cur, prior])]

    def block(y: Column, bare: str) -> list[Column]:
        return [F.when(fault == 3, F.lit(bare)).otherwise(period_text(plain, True, y)), none]

    channels = [
        _row(0, [F.lit("Channels"), *block(year, "Upto the quarter"), *block(before, "Upto the corresponding quarter of the previous year")]),
        _row(1, [none, *[F.lit(t) for t in ("No. of Policies", "Premium") * 2]]), _row(2, [F.lit("Brokers"), F.lit("1"), cur, F.lit("1"), prior])]
    words = [_row(0, [F.lit("Note"), F.lit("Basis")]), _row(1, [F.lit("Premium"), F.lit("as earned")]), _row(2, [F.lit("Claims"), F.lit("as paid")])]
    grouped = [
        _row(0, [F.lit("Note"), F.lit("Health"), F.when(fault == 4, F.lit("")).otherwise(F.lit("Travel"))]),
        _row(1, [F.lit(""), period_text(plain, True, year), period_text(plain, True, year)]), _row(2, [F.lit("Premium"), cur, prior])]
    pages = F.array(*[
        F.struct(F.lit(page).alias("page"), rows.alias("rows")) for page, rows in (
            (12, F.array(*statement)), (13, F.array(*balance)), (14, F.array(*channels)),
            (15, F.when(fault == 0, F.array(*words)).otherwise(F.array(*grouped))))])
    return wide.select("doc", "fy", filing_quarter().alias("quarter"), F.inline(pages)).select(
        "doc", "fy", "quarter", "page", F.lit(0).alias("tbl"), F.inline("rows"))


def misprinted_portfolio(spark, sf_dir) -> DataFrame:
    """Investments by code with a total row that is right, 0.4 % or 0.6 % too high, or blank, by filing number."""
    factor = F.element_at(F.array(*[F.lit(f).cast("decimal(4,3)") for f in ("1", "1.004", "1.006", None)]), (F.col("doc") % 4 + 1).cast("int"))
    return investment_grid(spark, sf_dir, factor)


# the commission schedule's own names of the channels, in the order of the channel form
COMMISSION_CHANNELS = ["Agents (individual)", "Bancassurance", "Other corporate agencies", "Broking houses", "Direct selling", "Web portals"]


def commission_grid(spark, sf_dir) -> DataFrame:
    """The commission schedule: commission by channel for both years, channels under other names than in the channel form."""
    base = figures(line_facts(spark, sf_dir, {"ch": channel_of()}), ["ch"], ["commission"])
    wide = base.groupBy("shard", "doc", "fy").agg(*[
        F.sum(F.when(F.col("ch") == n, F.col(f"commission_{k}"))).alias(f"{k}_{n}") for k in ("cc", "pc") for n in range(1, 7)])
    head = [F.lit("Channels"), *[period_text(F.lit(0), True, y) for y in (closes_in(), closes_in() - 1)]]
    rows = [_row(0, head), *[
        _row(n, [F.lit(name), printed(F.col(f"cc_{n}")), printed(F.col(f"pc_{n}"))]) for n, name in enumerate(COMMISSION_CHANNELS, 1)]]
    return wide.select("doc", "fy", filing_quarter().alias("quarter"), F.lit(16).alias("page"), F.lit(0).alias("tbl"), F.inline(F.array(*rows)))

"""Rows of a statement are sent once: columns, blocks and figures are worked out behind one exchange."""

import contextlib
import io
from decimal import Decimal

from pyspark.sql import functions as F

from peerlens.operators import grid, items
from peerlens.plans import render_filings as render

KEYS = ["doc", "fy", "page", "tbl"]
UPTO = "Upto the quarter ended December 31, {}"
FLAT = [["Particulars", UPTO.format(2025), None, UPTO.format(2024), None], ["", "Health", "Total", "Health", "Total"],
        ["Claims Incurred (Net)", "1", "10.50", "2", "(3)"], ["Commission", "4", "1,000", "5", "-"], ["Profit / (Loss) Before Tax", "6", "7", "8", "9"]]
STACKED = [["Particulars", UPTO.format(2025), None], ["", "Health", "Total"], ["Claims Incurred (Net)", "1", "2"], ["Commission", "1", "3"], ["Profit Before Tax", "9", "7"],
           ["Particulars", UPTO.format(2024), None], ["", "Health", "Total"], ["Claims Incurred (Net)", "1", "40"], ["Commission", "1", "50"], ["Profit Before Tax", "9", "8"]]


def table(spark, *tables):
    return spark.createDataFrame(
        [(d, 2025, 3, 1, 0, r, c) for d, cells in tables for r, c in enumerate(cells)],
        "doc int, fy int, quarter int, page int, tbl int, r bigint, cells array<string>")


def exchanges(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue().count("Exchange")


def test_group_sum(spark):
    rows = table(spark, (1, FLAT), (2, STACKED), (None, FLAT))
    met = grid.resolved_rows(rows, KEYS, by=KEYS, blocks=True)
    got = grid.sum_after_in_blocks(rows, met, KEYS, ["Claims Incurred"], "^Profit", include_anchor=True)
    assert exchanges(got) == 1
    want = {(1, 1010.5, -3.0), (2, 5.0, 90.0)}
    assert {(r.doc, r.cur, r.prior) for r in got.collect()} == want
    apart = grid.sum_after_in_blocks(rows, grid.resolved_rows(rows, KEYS), KEYS, ["Claims Incurred"], "^Profit", include_anchor=True)
    assert {(r.doc, r.cur, r.prior) for r in apart.collect()} == want


def test_statement(spark):
    rows = table(spark, (1, FLAT), (2, STACKED), (None, FLAT))
    got = items.income_statement(rows, ["doc", "fy"])
    assert exchanges(got) == 1
    assert {(r.doc, r["item"], r.cur, r.prior) for r in got.collect()} == {
        (1, "Claims", 10.5, -3.0), (1, "Commission", 1000.0, 0.0), (1, "PBT", 7.0, 9.0),
        (2, "Claims", 2.0, 40.0), (2, "Commission", 3.0, 50.0), (2, "PBT", 7.0, 8.0)}


def test_whole_cents(spark):
    units = [0, 1, 49, 50, 149, 150, -49, -50, -150, 123_456_750, -99_999_950, 12_345_678_901_234, (1 << 57) + 50]
    df = spark.createDataFrame([(u,) for u in units], "u long")
    old = F.round((F.col("u").cast("decimal(29,0)") / 10_000).cast("decimal(24,4)"), 2)
    for split in (False, True):
        got = df.select("u", render.printed_cents(render.whole_cents(F.col("u")), F.lit(split)).alias("a"), render.printed(old, F.lit(split)).alias("b")).collect()
        assert all(r.a == r.b for r in got), got


def test_figures_too_large_for_whole_numbers(spark):
    """Quarters whose sum is no BIGINT are added up exactly, with others beside them."""
    big = (1 << 63) - 1
    facts = spark.createDataFrame([(4, 2000, q, big) for q in (1, 2, 3, 4)] + [(5, 2000, 1, 15_050)], "supplier long, fy int, q int, v long")
    got = {(r.doc, r.fy): r.v_cc for r in render.figures(facts, [], ["v"]).collect()}
    assert got[(22, 2000)] == Decimal(4 * big).scaleb(-4).quantize(Decimal("0.01")) and got[(14, 2000)] == Decimal("1.51")

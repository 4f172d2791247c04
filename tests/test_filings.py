"""Rendered filings: quarters are copied into filings behind the last exchange, and nulls stay what they were."""

import contextlib
import io

import pytest

from peerlens.plans import render_filings as render


def above_exchange(df) -> str:
    """The part of a plan that no exchange follows."""
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue().split("Exchange")[0]


@pytest.mark.parametrize("grid", [render.statement_grid, render.channel_grid, render.investment_grid])
def test_filings_are_not_shuffled(spark, sf_dir, grid):
    assert "sequence(" in above_exchange(grid(spark, sf_dir))


def test_figures_of_filings(spark):
    rows = [(4, 2000, 1, 10_000), (4, 2000, 3, 20_000), (4, 2000, 3, 5_000), (5, 2000, 4, None), (None, 2000, 3, 10_000), (6, 2000, None, 1)]
    facts = spark.createDataFrame(rows, "supplier long, fy int, q int, v long")
    num = lambda x: None if x is None else float(x)
    got = {(r.doc, r.fy): (num(r.v_cc), num(r.v_cq), num(r.v_pc), num(r.v_pq)) for r in render.figures(facts, [], ["v"]).collect()}
    assert got == {
        (13, 2000): (1, 1, 0, 0), (16, 2000): (1, 0, 0, 0), (19, 2000): (3.5, 2.5, 0, 0), (22, 2000): (3.5, 0, 0, 0),
        (13, 2001): (0, 0, 1, 1), (16, 2001): (0, 0, 1, 0), (19, 2001): (0, 0, 3.5, 2.5), (22, 2001): (0, 0, 3.5, 0),
        (23, 2000): (None, None, 0, 0), (23, 2001): (0, 0, None, None),
        (None, 2000): (2, 0, 0, 0), (None, 2001): (0, 0, 2, 0)}


def test_lines_meet_their_orders_as_stored(spark, sf_dir):
    """Measures are more than the columns they are made from: none is worked out before the lines are sent to their orders."""
    out, own = io.StringIO(), "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(own)
    spark.conf.set(own, "-1")
    try:
        with contextlib.redirect_stdout(out):
            render.line_facts(spark, sf_dir).groupBy("supplier").sum("gross", "claims", "pbt").explain(True)
    finally:
        spark.conf.set(own, before)
    above, below = out.getvalue().split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0].split("Join Inner")
    assert "AS pbt" in above and "l_extendedprice" in below
    assert not any(f"AS {m}" in below for m in ("value", "gross", "claims", "pbt"))

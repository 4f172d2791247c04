"""The whole income statement of every filing, from grids and texts, against plain aggregates."""

from __future__ import annotations

from ..operators import income
from ..session import written_table
from . import render_income as render
from .queries_grid import FILINGS
from .registry import query

CR = "CAST(round(CAST({} AS DECIMAL(24,4)) * CAST(0.01 AS DECIMAL(4,2)), 2) AS DOUBLE)"


def _figures() -> str:
    out = []
    for n, (of, test) in render.MEASURES.items():
        for t, now in (("c", "now"), ("p", "NOT now")):
            out.append(f"CAST(coalesce(round(SUM({of}) FILTER ({now} AND {test or 'true'}), 2), 0) AS DECIMAL(24,4)) AS {n}_{t}")
    return ", ".join(out)


ITEMS = {
    "Gross Written Premium": "gross_{t} + accepted_{t}", "NL-4 GDPI": "gross_{t}", "Net Written Premium": "value_{t}", "Earned Premium": "earned_{t}",
    "Claims": "claims_{t}", "Net Incurred Claims": "claims_{t}", "Operating Expenses": "opex_{t}", "Net Commission": "commission_{t}",
    "Gross Commission": "CASE WHEN doc % 7 = 0 AND doc % 3 <> 2 THEN com_a_{t} + com_b_{t} + com_c_{t} ELSE commission_{t} END",
    "RI Accepted Commission": "ri_com_{t}", "GST": "gst_{t}", "In House Claim Processing Cost": "in_house_{t}", "PBT": "pbt_{t}", "PAT": "pat_{t}",
    "CEO Remuneration": "ceo_{t}",
    "Investment Income": "ph_int_{t} + ph_sale_{t} + sh_int_{t} + sh_profit_{t} + sh_amort_{t} - CASE WHEN doc % 3 = 2 THEN 0 ELSE sh_loss_{t} END",
    "Other Income": "other_a_{t} + other_b_{t}", "Contribution to Policyholders": "CASE WHEN doc % 3 = 2 THEN contribution_{t} ELSE con_1_{t} + ceo_{t} + con_3_{t} END",
    "Total Overheads": "commission_{t} + opex_{t} + total_b_{t} - CASE WHEN doc % 3 = 2 THEN contribution_{t} ELSE con_1_{t} + ceo_{t} + con_3_{t} END - (other_a_{t} + other_b_{t})",
}


@query("income_statement", FILINGS + f"""
, s AS (SELECT doc, fy, {_figures()} FROM filed GROUP BY doc, fy)""" + " UNION ALL ".join(
    f" SELECT doc, fy, '{n}' AS item, {CR.format(e.format(t='c'))} AS cur, {CR.format(e.format(t='p'))} AS prior FROM s" for n, e in ITEMS.items()))
def income_statement(spark, sf_dir):
    base = written_table(render.base(spark, sf_dir), "income-base")
    rows, pages = written_table(render.grids(base), "income-grids"), written_table(render.texts(base), "income-texts")
    return income.income_statement(rows, pages, ["doc", "fy"])

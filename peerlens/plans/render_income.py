"""The five schedules of the income statement rendered from order lines, as grids or, for every third filer, as text.

Odd filers put the quarter before the cumulative column; every fourth filer prints last year's part of NL-7 on a page of its
own; every seventh leaves the gross commission blank and prints its parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import render_filings as render

# measure -> of which base measure, for which lines (SQL says the same in queries_income)
MEASURES = {
    "gross": ("gross", ""), "accepted": ("accepted", ""), "value": ("value", ""), "earned": ("value", "status = 'F'"), "claims": ("claims", ""),
    "commission": ("commission", ""), "opex": ("opex", ""), "ph_int": ("commission", "flag = 'A'"), "ph_sale": ("commission", "flag = 'N'"),
    "sh_int": ("commission", "flag = 'R'"), "sh_profit": ("ceded", "flag = 'A'"), "sh_loss": ("ceded", "flag = 'N'"), "sh_amort": ("ceded", "flag = 'R'"),
    "other_a": ("commission", "status = 'O'"), "other_b": ("commission", "status = 'F'"), "con_1": ("accepted", "flag = 'A'"),
    "ceo": ("accepted", "flag = 'N'"), "con_3": ("accepted", "flag = 'R'"), "total_b": ("ceded", "status = 'O'"), "pbt": ("pbt", ""),
    "pat": ("value", "flag <> 'N'"), "com_a": ("commission", "flag <> 'R'"), "com_b": ("commission", "flag = 'R' AND status = 'O'"),
    "com_c": ("commission", "flag = 'R' AND status = 'F'"), "ri_com": ("accepted", "flag <> 'A'"), "gst": ("ceded", "flag <> 'R'"),
    "in_house": ("claims", "flag = 'A'"), "contribution": ("accepted", ""),
}
KINDS = ("cc", "cq", "pc", "pq")


def base(spark, sf_dir) -> DataFrame:
    """doc, fy, measure, f, minus: the printed figures (cc, cq, pc, pq) of every measure, and the same with the sign changed where a line asks for it."""
    extra = {f"m_{n}": F.when(F.expr(test or "true"), F.col(of)).otherwise(0) for n, (of, test) in MEASURES.items()}
    facts = render.by_shard(render.line_facts(spark, sf_dir, extra).groupBy("supplier", "fy", "q").agg(*[F.sum(f"m_{n}").alias(n) for n in MEASURES]))
    long = facts.select("shard", "supplier", "fy", "q", F.inline(F.array(*[F.struct(F.lit(n).alias("measure"), F.col(n).alias("v")) for n in MEASURES])))
    found = render.filed_figures(long, ["measure"], ["v"])
    values = F.array(*[F.col(f"v_{k}") for k in KINDS])
    minus = F.when(F.col("measure").isin(*_negated()), F.transform(values, lambda v: render.printed(-v)))
    return found.select("doc", "fy", "measure", F.transform(values, lambda v: render.printed(v)).alias("f"), minus.alias("minus"))


def _negated() -> list[str]:
    """Measures that some line prints with the sign changed."""
    return sorted({m[1:] for rows in [*(r for _, r in FORMS.values()), *TEXT.values()] for _, m in rows if m and m.startswith("-")})


def is_text() -> Column:
    return F.col("doc") % 3 == 2


NL4 = [("Gross Direct Premium", "gross"), ("Add: Premium on reinsurance accepted", "accepted"), ("Net Written Premium", "value"), ("Net Earned Premium", "earned")]
NL1 = [("Claims Incurred (Net)", "claims"), ("Commission", "commission"), ("Operating Expenses related to Insurance Business", "opex"),
       ("Interest, Dividend & Rent - Gross", "ph_int"), ("Profit / Loss on sale / redemption of investments", "ph_sale")]
NL2 = [("Interest, Dividend & Rent", "sh_int"), ("Profit on sale of investments", "sh_profit"), ("Loss on sale of investments", "-sh_loss"),
       ("Amortization of Premium / Discount", "sh_amort"), ("OTHER INCOME", None), ("(a) Gain on exchange", "other_a"), ("(b) Provisions written back", "other_b"),
       ("TOTAL (A)", "gross"), ("(f) Contribution to Policyholders' A/c", None), ("(i) Towards Excess Expenses of Management", "con_1"),
       ("(ii) Towards remuneration of MD/CEO/WTD/Other KMPs", "ceo"), ("(iii) Others", "con_3"), ("(g) Others", "opex"), ("TOTAL (B)", "total_b"),
       ("Profit / (Loss) Before Tax", "pbt"), ("Profit / (Loss) after tax", "pat")]
NL6 = [("Gross Commission", "gross commission"), ("Commission & Remuneration", "com_a"), ("Rewards", "com_b"), ("Distribution fees", "com_c"), ("Add: Re-insurance Accepted", "ri_com")]
NL7 = [("Goods and Services Tax (GST)", "gst"), ("Others: In House Claim Processing Cost", "-in_house")]
TEXT = {
    "NL-4": [(label, m) for label, m in NL4],
    "NL-1": [("Claims Incurred (Net) NL-5", "claims"), ("Commission NL-6", "commission"), ("Operating Expenses related to Insurance Business NL-7", "opex"),
             ("Interest, Dividend and Rent - (Gross)", "ph_int"), ("Profit / Loss on Sale of Investments", "ph_sale")],
    "NL-2": [("Interest and Dividend Income", "sh_int"), ("Profit and Loss on Sale of Investments", "sh_profit"), ("Amortisation of Premium", "sh_amort"),
             ("OTHER INCOME", None), ("Gain on exchange", "other_a"), ("Provisions written back", "other_b"), ("TOTAL (A)", "gross"),
             ("Contribution to Policyholders Funds towards excess EoM", "contribution"), ("of which remuneration of MD and others", "ceo"),
             ("TOTAL (B)", "total_b"), ("Profit Before Tax Exceptional Items", "value"), ("Profit Before Tax", "pbt"), ("Profit after tax", "pat")],
    "NL-6": [("Direct Commission", "commission"), ("Reinsurance Accepted", "ri_com")],
    "NL-7": [("16 Goods and Service Tax", "gst"), ("17 In House Claim Processing Cost", "-in_house")],
}
FORMS = {"NL-4": (1, NL4), "NL-1": (2, NL1), "NL-2": (3, NL2), "NL-6": (4, NL6), "NL-7": (5, NL7)}


FIGURE, MINUS, DASH, HEAD, GROSS = range(5)  # what a line shows


def _places(forms: dict[str, list]) -> Column:
    """measure -> where it is printed: form, page, line, label, what; lines without a figure of their own come with `gross`."""
    out: dict[str, list] = {m: [] for m in MEASURES}
    for form, rows in forms.items():
        page = FORMS[form][0]
        out["gross"].append((form, page, 0, "Particulars", HEAD))
        for n, (label, m) in enumerate(rows, 1):
            what = DASH if m is None else GROSS if m == "gross commission" else MINUS if m.startswith("-") else FIGURE
            out["commission" if what == GROSS else "gross" if m is None else m.lstrip("-")].append((form, page, n, label, what))
    names = ("form", "page", "r", "label", "what")
    entries = [(F.lit(m), F.array(*[F.struct(*[F.lit(x).alias(k) for x, k in zip(row, names)]) for row in rows])) for m, rows in out.items() if rows]
    return F.create_map(*[x for e in entries for x in e])


def _head(k: str) -> Column:
    year = render.closes_in() if k[0] == "c" else render.closes_in() - 1
    return render.period_text(F.col("doc") % 5, k[1] == "c", year)


def _shown(lines: DataFrame) -> Column:
    """The four cells of a line."""
    dashes = F.array_repeat(F.lit("-"), 4)
    what = F.col("what")
    return (
        F.when(what == HEAD, F.array(*[_head(k) for k in KINDS])).when(what == MINUS, F.col("minus")).when(what == DASH, dashes)
        .when((what == GROSS) & (F.col("doc") % 7 == 0) & ~is_text(), dashes).otherwise(F.col("f")))


def grids(base: DataFrame) -> DataFrame:
    """doc, fy, quarter, form, page, tbl, r, cells of the filers that print grids."""
    lines = base.where(~is_text()).select("doc", "fy", "f", "minus", F.inline(F.element_at(_places({f: rows for f, (_, rows) in FORMS.items()}), F.col("measure"))))
    lines = lines.withColumn("shown", _shown(lines))
    ordered = lambda a, b: F.when(F.col("doc") % 2 == 1, F.array(F.col("shown")[b], F.col("shown")[a])).otherwise(F.array(F.col("shown")[a], F.col("shown")[b]))
    now, last = ordered(0, 1), ordered(2, 3)
    part = lambda offset, cells: F.struct(F.lit(offset).alias("offset"), cells.alias("figures"))
    split = (F.col("form") == "NL-7") & (F.col("doc") % 4 == 1)
    parts = F.when(split, F.array(part(0, now), part(1, last))).otherwise(F.array(part(0, F.concat(now, last))))
    lines = lines.select("doc", "fy", "form", "page", F.col("r").cast("bigint").alias("r"), "label", F.inline(parts))
    return lines.select(
        "doc", "fy", render.filing_quarter().alias("quarter"), "form", (F.col("page") + F.col("offset")).alias("page"), F.lit(0).alias("tbl"), "r",
        F.concat(F.array("label"), "figures").alias("cells"))


def texts(base: DataFrame) -> DataFrame:
    """doc, fy, quarter, form, page, text: the schedules of all filers as text lines; where there is a grid it says nothing new."""
    swap = F.col("doc") % 2 == 1  # last year's pair the other way round
    cur, prior = (render.closing_day("ordinal", render.closes_in() - n) for n in (0, 1))
    up, fo = "Upto the quarter", "For the quarter"
    labels = F.when(swap, F.lit(f"{up} {fo} {fo} {up}")).otherwise(F.lit(f"{up} {fo} {up} {fo}"))
    header = F.concat_ws("\n", labels, F.concat_ws(" ", cur, cur, prior, prior))
    lines = base.select("doc", "fy", "f", "minus", F.inline(F.element_at(_places(TEXT), F.col("measure"))))
    shown = _shown(lines)
    figures = F.when(swap, F.concat(F.slice(shown, 1, 2), F.array(shown[3], shown[2]))).otherwise(shown)
    line = (
        F.when(F.col("what") == HEAD, F.concat_ws("\n", F.concat(F.lit("FORM "), F.col("form")), header))
        .when(F.col("what") == DASH, F.col("label")).otherwise(F.concat_ws(" ", F.array("label"), figures)))
    # as many lines as a schedule has
    listed = F.sort_array(F.collect_list(F.struct("r", line.alias("line"))))
    pages = lines.groupBy("doc", "fy", "form", "page").agg(F.array_join(F.transform(listed, lambda x: x["line"]), "\n").alias("text"))
    return pages.withColumn("quarter", render.filing_quarter())

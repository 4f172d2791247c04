"""Claims settled by amount: form pages in text and tables, blocks told apart by their headings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import items
from ..session import written_table
from . import render_filings as render
from .queries_grid import FILINGS, OWN_QUARTER, fig
from .registry import query

# step -> lines it counts
STEPS = {"start": ("O", "N"), "booked": ("O", "A"), "reopened": ("F", "A"), "settled": ("F", "N"), "end": ("O", "R")}


def claim_form(spark, sf_dir):
    """doc, fy, quarter and the figures of each block: amounts and counts, year to date and of the quarter."""
    facts = render.line_facts(spark, sf_dir)
    extra = {f"{m}_{n}": F.when((F.col("status") == s) & (F.col("flag") == f), F.col(m)).otherwise(0) for n, (s, f) in STEPS.items() for m in ("gross", "lines")}
    return render.figures(facts.withColumns(extra), [], list(extra)).drop("shard").withColumn("quarter", render.filing_quarter())


def _block(measure: str, k: str, words: str, sub_rows: bool) -> list:
    """Heading and (label, value) lines of a block; the sub-rows carry the reported total where its own row is blank."""
    v = lambda n: F.col(f"{measure}_{n}_{k}")
    reported = None if sub_rows else v("booked") + v("reopened")
    return [
        (words, None), ("Sl Particulars Health Total", None), ("Claims O/S at the beginning of the period", v("start")), ("Claims reported during the period", reported),
        ("(a) Booked during the period", v("booked")), ("(b) Reopened during the period", v("reopened")), ("Claims Settled during the period", v("settled")),
        ("Claims Repudiated during the period", F.lit(3).cast("decimal(24,2)")), ("Claims O/S at End of the period", v("end")), ("Less than 3 months", v("end"))]


def _blocks() -> list:
    """For each of three layouts the pages with their blocks: the first is tagged, the form may go on behind it."""
    year, quarter = "up to the quarter", "for the quarter"
    out = []
    for sub_rows in (False, True):
        amount = lambda k, t, s=sub_rows: _block("gross", k, f"Amount in Rs. Lakhs {t}", s)
        count = lambda k, t, s=sub_rows: _block("lines", k, f"No. of claims only {t}", s)
        out.append([[count("cc", year), amount("cc", year)], []])
        out.append([[count("cq", quarter), amount("cq", quarter), count("cc", year)], [amount("cc", year)]])
        out.append([[amount("cq", quarter), count("cq", quarter)], []])
    return out


def _shown(v):
    return F.format_number(v, 2)


def claim_pages(form):
    """doc, fy, quarter, page, text, tagged."""
    def text(title: str, blocks: list):
        lines = [F.lit(title)]
        for block in blocks:
            lines += [F.lit(label) if v is None else F.concat_ws(" ", F.lit(label), F.lit("1.00"), _shown(v)) for label, v in block]
        return F.concat_ws("\n", *lines)

    out = None
    for n, (first, second) in enumerate(_blocks()):
        texts = F.array(text("FORM NL-37 CLAIMS DATA", first), text("continued", second))
        part = form.where(F.col("doc") % 6 == n).select("doc", "fy", "quarter", F.posexplode(texts).alias("at", "text"))
        out = part if out is None else out.unionByName(part)
    return out.select("doc", "fy", "quarter", (F.col("at") + 11).alias("page"), "text", (F.col("at") == 0).alias("tagged"))


def claim_tables(form):
    """doc, fy, page, tbl, r, cells: the blocks as tables, of every other three filers; one in four of them lacks a block."""
    out = None
    for n, (first, second) in enumerate(_blocks()):
        printed = [(page, label, v) for page, blocks in ((11, first), (12, second)) for block in blocks for label, v in block[1:]]
        cells = F.array(*[F.struct(F.lit(page).alias("page"), F.lit(r).cast("bigint").alias("r"), F.array(
            F.lit(label), F.lit(None if v is None else "1.00"), F.lit(None).cast("string") if v is None else _shown(v)).alias("cells"))
            for r, (page, label, v) in enumerate(printed)])
        part = form.where((F.col("doc") % 6 == n) & (F.col("doc") % 4 < 2)).select("doc", "fy", F.inline(cells))
        out = part if out is None else out.unionByName(part)
    return out.where((F.col("doc") % 4 == 0) | (F.col("r") != 1)).withColumn("tbl", F.lit(0))


def _step(n: str, quarter: str) -> str:
    status, flag = STEPS[n]
    return fig("gross", True, f"status = '{status}' AND flag = '{flag}' AND {quarter}")


@query("claims_amount_ratio", FILINGS + f"""
, s AS (SELECT doc, fy, {', '.join(f"{_step(n, 'true')} AS y_{n}, {_step(n, OWN_QUARTER)} AS q_{n}" for n in STEPS)} FROM filed GROUP BY doc, fy)
, p AS (SELECT doc, fy, {', '.join(f"CASE WHEN doc % 3 = 2 THEN q_{n} ELSE y_{n} END AS {n}" for n in STEPS)} FROM s)
, t AS (SELECT doc, fy, start AS os_start, CAST(CAST(booked AS DECIMAL(24,4)) + CAST(reopened AS DECIMAL(24,4)) AS DOUBLE) AS reported, settled, p.end AS os_end FROM p)
SELECT doc, fy, CASE doc % 3 WHEN 0 THEN 2 WHEN 1 THEN 4 ELSE 1 END::BIGINT AS block, CASE WHEN doc % 4 = 0 THEN 'table' ELSE 'text' END AS source,
  os_start, reported, settled, os_end, round(settled / nullif(os_start + reported - os_end, 0), 4) AS csr FROM t""")
def claims_amount_ratio(spark, sf_dir):
    form = written_table(claim_form(spark, sf_dir), "claim-form")
    pages, rows = written_table(claim_pages(form), "claim-pages"), written_table(claim_tables(form), "claim-tables")
    return items.claims_amount_ratio(pages, rows, ["doc", "fy"], F.col("tagged"))

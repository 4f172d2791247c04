"""Text-line queries: gridless pages rendered from order lines and read back; printed figures and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers as num
from ..functions import text as txt
from ..functions.periods import normalize_fy, two_digits
from ..operators import items, lines
from ..sources.tables import read_table
from . import render_filings as render
from .queries_grid import FILINGS, OWN_QUARTER, fig
from .registry import query, staged

TEXT_ITEMS = [("10 Gross Premium NL-4", "gross"), ("11 Claims Incurred (Net) NL-5", "claims"), ("12 Commission NL-6", "commission"),
              ("13 Operating Expenses NL-7", "opex"), ("Profit Before Tax Exceptional Items", "value"), ("Profit Before Tax", "pbt")]


def text_pages(spark, sf_dir):
    """doc, fy, quarter, page, text: header, items and figures as lines; column order varies by filer.

    Filers differ in the place of the years (same line, two lines below, absent) and in how figures are torn.
    """
    measures = [m for _, m in TEXT_ITEMS]
    base = render.figures(render.line_facts(spark, sf_dir), [], measures)
    style = F.col("doc") % 4
    torn = F.col("doc") % 3 == 1

    def figure(m, k):
        v = F.col(f"{m}_{k}")
        t = F.format_number(F.abs(v), 2)
        t = F.when(torn, F.regexp_replace(F.regexp_replace(t, ",(\\d{3}\\.)", " ,$1"), r"\.", " .")).otherwise(t)
        return F.when(v < 0, F.concat(F.lit("( "), t, F.lit(")"))).when(v == 0, F.lit("-")).otherwise(t)

    cur, prior = render.closes_in(), render.closes_in() - 1
    y = lambda e: render.closing_day("ordinal", e)
    s = lambda e: render.closing_day("short", e)
    up, fo = "Upto the quarter", "For the quarter"
    wide_order = style != 1
    labels = F.when(wide_order, F.lit(f"{up} {fo} {up} {fo}")).otherwise(F.lit(f"{up} {fo} {fo} {up}"))
    year_line = (
        F.when(style == 2, F.concat_ws(" ", s(cur), s(cur), s(prior), s(prior)))
        .when(style == 3, F.lit("(current) (current) (previous) (previous)"))
        .otherwise(F.concat_ws(" ", y(cur), y(cur), y(prior), y(prior))))
    header = F.when(style == 2, F.concat_ws("\n", labels, F.lit("ended"), year_line)).otherwise(F.concat_ws("\n", labels, year_line))

    def item(label, m):
        cc, cq, pc, pq = (figure(m, k) for k in ("cc", "cq", "pc", "pq"))
        return F.concat_ws(" ", F.lit(label), cc, cq, F.when(wide_order, pc).otherwise(pq), F.when(wide_order, pq).otherwise(pc))

    text = F.concat_ws("\n", F.lit("FORM NL-2-B-PL"), F.lit("PROFIT AND LOSS ACCOUNT"), header, *[item(n, m) for n, m in TEXT_ITEMS], F.lit("Page 1"))
    return base.select("doc", "fy", render.filing_quarter().alias("quarter"), F.lit(1).alias("page"), text.alias("text"))


LABELS = {"gross": [["Gross Direct Premium"], ["Gross Premium"]], "claims": [["Claims Incurred", "(Net)"]], "commission": [["Commission"]],
          "opex": [["Operating Expenses"]], "pbt": [["Before Tax"]]}


@query("text_line_item", FILINGS + " UNION ALL ".join(
    f" SELECT doc, fy, '{m}' AS item, {fig(m, True)} AS cur, {fig(m, False)} AS prior FROM filed GROUP BY doc, fy" for m in LABELS))
def text_line_item(spark, sf_dir):
    pages = lines.period_columns(staged(text_pages, spark, sf_dir))
    return lines.line_item(pages, ["doc", "fy"], LABELS, {"pbt": ["Exceptional"]})


@query("text_group_sum", FILINGS + f"""
, s AS (SELECT doc, fy, {', '.join(f'{fig(m, n)} AS {m}_{t}' for m in ('claims', 'commission', 'opex') for n, t in ((True, 'c'), (False, 'p')))} FROM filed GROUP BY doc, fy)
SELECT doc, fy, {', '.join(f"CAST(CAST(claims_{t} AS DECIMAL(24,4)) + CAST(commission_{t} AS DECIMAL(24,4)) + CAST(opex_{t} AS DECIMAL(24,4)) AS DOUBLE) AS {n}" for t, n in (('c', 'cur'), ('p', 'prior')))} FROM s""")
def text_group_sum(spark, sf_dir):
    # serial numbers in front of a label are figures too: this form prints none in front of its group rows
    pages = staged(text_pages, spark, sf_dir).withColumn("text", F.regexp_replace("text", r"(?m)^1\d ", ""))
    return lines.sum_lines_after(lines.period_columns(pages), ["doc", "fy"], ["Claims Incurred (Net)"], "(?i)^profit")


@query("text_column_order", FILINGS + """
SELECT doc, fy, 0 AS cur_n, CASE WHEN doc % 4 = 1 THEN 3 ELSE 2 END AS prior_n, doc % 4 = 3 AS by_order FROM docs""")
def text_column_order(spark, sf_dir):
    return lines.period_columns(staged(text_pages, spark, sf_dir)).select("doc", "fy", "cur_n", "prior_n", "by_order")


@query("resolution_issues", FILINGS + """
SELECT doc, fy, 'period columns' AS op, 'no usable years: columns taken in reading order' AS reason FROM docs WHERE doc % 4 = 3""")
def resolution_issues(spark, sf_dir):
    return lines.unresolved(lines.period_columns(staged(text_pages, spark, sf_dir)), ["doc", "fy"])


@query("line_total", FILINGS + f" SELECT doc, fy, {fig('gross', False, OWN_QUARTER) } AS total FROM filed GROUP BY doc, fy")
def line_total(spark, sf_dir):
    # the last figure of the line: last year's quarter, but for filers that swap the pair
    pages = lines.with_lines(staged(text_pages, spark, sf_dir))
    line = F.get(F.filter("lines", lambda x: x.contains("Gross Premium")), F.lit(0))
    last = num.last_number(line)
    third = F.get(num.line_numbers(lines.after_label(line, ["Gross Premium"])), F.lit(2))
    dashed = F.when(F.trim(line).endswith("-"), F.lit(0.0)).otherwise(last)
    return pages.select("doc", "fy", F.when(F.col("doc") % 4 == 1, third).otherwise(dashed).alias("total"))


@query("heading_distance", FILINGS + """
SELECT doc, fy, CAST(3 + CASE WHEN doc % 4 = 2 THEN 2 ELSE 1 END AS INTEGER) AS first_item, 'PROFIT AND LOSS ACCOUNT' AS heading FROM docs""")
def heading_distance(spark, sf_dir):
    pages = lines.with_lines(staged(text_pages, spark, sf_dir))
    long = pages.select("doc", "fy", F.posexplode("lines").alias("r", "text"))
    near = items.nearest_heading(long, ["doc", "fy"], F.col("text").contains("ACCOUNT"))
    return near.where(F.col("text").startswith("10 Gross")).select("doc", "fy", F.col("r").alias("first_item"), "heading")


# ---- printed figures and labels --------------------------------------------------------

def printed_prices(spark, sf_dir):
    c = F.col("o_totalprice")
    text = F.format_number(c, 2)
    style = F.col("o_orderkey") % 6
    return read_table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("okey"),
        F.when(style == 0, text).when(style == 1, F.concat(F.lit("("), text, F.lit(")"))).when(style == 2, F.regexp_replace(text, ",", " ,"))
        .when(style == 3, F.concat(text, F.lit(" %"))).when(style == 4, F.lit("-")).otherwise(F.concat(F.lit("n.a. "), text)).alias("cell"))


PRICE = "CAST(round(CAST(o_totalprice AS DECIMAL(18,4)), 2) AS DOUBLE)"


@query("printed_number", f"""
SELECT o_orderkey AS okey,
  CASE o_orderkey % 6 WHEN 0 THEN {PRICE} WHEN 1 THEN -{PRICE} WHEN 2 THEN {PRICE} WHEN 4 THEN 0.0 END AS number,
  CASE o_orderkey % 6 WHEN 0 THEN {PRICE} WHEN 1 THEN -{PRICE} WHEN 2 THEN {PRICE} WHEN 3 THEN {PRICE} END AS cell_number FROM orders""")
def printed_number(spark, sf_dir):
    return printed_prices(spark, sf_dir).select(
        "okey", num.printed_number(F.col("cell")).alias("number"), num.cell_number(F.col("cell")).alias("cell_number"))


@query("normalize_fy", """
WITH o AS (SELECT o_orderkey, CAST(year(o_orderdate - INTERVAL 3 MONTH) AS INTEGER) + 25 AS fy, o_orderkey % 8 AS s FROM orders)
SELECT o_orderkey AS okey, CASE WHEN s = 6 THEN NULL WHEN s = 7 THEN NULL ELSE fy END AS fy FROM o""")
def normalize_fy_query(spark, sf_dir):
    from ..functions.periods import fiscal_year

    fy, s = fiscal_year("o_orderdate") + 25, F.col("o_orderkey") % 8
    a, b, yy, zz = fy.cast("string"), (fy + 1).cast("string"), two_digits(fy), two_digits(fy + 1)
    spelled = (
        F.when(s == 0, F.concat(F.lit("FY"), yy, F.lit("-"), zz)).when(s == 1, F.concat(F.lit("fy "), yy, F.lit("/"), zz))
        .when(s == 2, F.concat(a, F.lit("-"), zz)).when(s == 3, F.concat(a, F.lit("_"), b)).when(s == 4, F.concat(F.lit("FY"), zz))
        .when(s == 5, b).when(s == 6, F.concat(yy, F.lit("-"), two_digits(fy + 2))).otherwise("banana"))
    return read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("okey"), normalize_fy(spelled).alias("fy"))


@query("fold_text", r"""
WITH t AS (SELECT p_partkey, '  ' || p_name || '  -  ' || p_type || '   & ' || p_brand || ' ' AS label FROM part)
SELECT p_partkey AS partkey, trim(regexp_replace(regexp_replace(lower(label), '\s*-\s*', '-', 'g'), '\s+', ' ', 'g')) AS folded,
  regexp_replace(lower(label), '[^a-z0-9]', '', 'g') AS key,
  trim(regexp_replace(label, '[^0-9a-zA-Z]+', '_', 'g'), '_') AS identifier,
  replace(replace(lower(label), ' ', '-'), '&', 'and') AS slug, replace(replace(label, ' ', '_'), '&', 'and') || '.pdf' AS file_name FROM t""")
def fold_text(spark, sf_dir):
    label = F.concat(F.lit("  "), "p_name", F.lit("  -  "), "p_type", F.lit("   & "), "p_brand", F.lit(" "))
    return read_table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("partkey"), txt.fold_text(label).alias("folded"), txt.fold_label(label).alias("key"),
        txt.identifier(label).alias("identifier"), txt.slug(label).alias("slug"), txt.download_name(label).alias("file_name"))


@query("unit_conversion", """
SELECT o_orderkey AS okey, ['money', 'percent', 'ratio', 'count'][CAST(o_orderkey % 4 AS INTEGER) + 1] AS kind,
 CASE o_orderkey % 4 WHEN 0 THEN CAST(round(CAST(o_totalprice AS DECIMAL(18,2)) * CAST(0.01 AS DECIMAL(4,2)), 2) AS DOUBLE) WHEN 1 THEN round(o_totalprice / 100, 4) WHEN 2 THEN round(o_totalprice, 4) ELSE round(o_totalprice) END AS value,
 CASE WHEN o_totalprice / 1000 > 20 THEN o_totalprice / 1000 / 100 ELSE o_totalprice / 1000 END AS multiple FROM orders""")
def unit_conversion(spark, sf_dir):
    kind = F.element_at(F.array(*[F.lit(k) for k in ("money", "percent", "ratio", "count")]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return read_table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("okey"), kind.alias("kind"), num.convert_units(F.col("o_totalprice"), kind).alias("value"),
        num.as_multiple(F.col("o_totalprice") / 1000).alias("multiple"))


# conversations stand in for documents of several pages: a turn is a page
@query("first_matching_page", """
SELECT conv_id, min(turn) AS turn FROM conversations WHERE regexp_matches(text, '(?i)\\b(the|and)\\b') GROUP BY conv_id""")
def first_matching_page(spark, sf_dir):
    pages = read_table(spark, sf_dir, "conversations")
    return lines.pages_matching(pages, ["conv_id"], r"(?i)\b(the|and)\b", "turn").select("conv_id", "turn")


@query("continuation_pages", """
WITH last AS (SELECT conv_id, max(turn) AS t FROM conversations WHERE role = 'user' GROUP BY conv_id)
SELECT c.conv_id, c.turn FROM conversations c JOIN last l USING (conv_id)
WHERE c.role = 'user' OR (c.turn = l.t + 1 AND regexp_matches(c.text, '^[A-M]'))""")
def continuation_pages(spark, sf_dir):
    pages = read_table(spark, sf_dir, "conversations")
    return lines.with_continuation(pages, ["conv_id"], F.col("role") == "user", "^[A-M]", "turn").select("conv_id", "turn")

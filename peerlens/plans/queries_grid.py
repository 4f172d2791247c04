"""Cell-grid queries: rendered filings of every supplier read back, compared with plain aggregates."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import fixed_values as fixed
from ..functions.numbers import printed_number
from ..operators import grid, items
from ..session import shared_dir
from ..sources import filings
from . import render_filings as render
from .registry import query, staged

KEYS = render.KEYS

FILINGS = """
WITH f AS (
  SELECT (l_suppkey // 3) * 12 + (closing - 1) * 3 + l_suppkey % 3 AS doc, l_partkey AS partkey, o_orderpriority AS channel, l_returnflag AS flag, l_linestatus AS status,
    CAST(year(o_orderdate - INTERVAL 3 MONTH) AS INTEGER) AS fy0, CAST(quarter(o_orderdate - INTERVAL 3 MONTH) AS INTEGER) AS q,
    CASE l_returnflag WHEN 'A' THEN 'Health' WHEN 'N' THEN 'Personal Accident' ELSE 'Travel' END AS segment,
    price * (CAST(1 AS DECIMAL(4,2)) - disc) AS value, price AS gross, price * disc AS ceded, price * tax AS commission,
    CASE WHEN l_linestatus = 'F' THEN price * disc ELSE 0 END AS accepted, price * disc AS opex,
    CASE WHEN l_linestatus = 'O' THEN price * (CAST(1 AS DECIMAL(4,2)) - disc) ELSE 0 END AS claims,
    price * (CAST(1 AS DECIMAL(4,2)) - disc) - 2 * CASE WHEN l_linestatus = 'O' THEN price * (CAST(1 AS DECIMAL(4,2)) - disc) ELSE 0 END - price * tax AS pbt,
    CAST(1 AS DECIMAL(18,4)) AS lines
  FROM (SELECT *, CAST(l_extendedprice AS DECIMAL(18,2)) AS price, CAST(l_discount AS DECIMAL(4,2)) AS disc, CAST(l_tax AS DECIMAL(4,2)) AS tax FROM lineitem)
  JOIN orders ON l_orderkey = o_orderkey JOIN (VALUES (1), (2), (3), (4)) c(closing) ON quarter(o_orderdate - INTERVAL 3 MONTH) <= closing)
, filed AS (SELECT *, fy0 + s AS fy, s = 0 AS now FROM f, (VALUES (0), (1)) t(s))
, docs AS (SELECT DISTINCT doc, fy FROM filed)"""


OWN_QUARTER = "q = (doc // 3) % 4 + 1"


def fig(m: str, now: bool, extra: str = "true") -> str:
    """Printed figure of a measure: cumulative, two decimals, zero when nothing."""
    return f"coalesce(CAST(round(SUM({m}) FILTER ({'now' if now else 'NOT now'} AND {extra}), 2) AS DOUBLE), 0)"


ITEMS_SQL = [("Gross Direct Premium", "gross"), ("Accepted", "accepted"), ("Net Written Premium", "value"), ("Claims", "claims"),
             ("Commission", "commission"), ("Operating Expenses", "opex"), ("PBT", "pbt")]


@query("grid_line_item", FILINGS + " UNION ALL ".join(
    f" SELECT doc, fy, '{n}' AS item, {fig(m, True)} AS cur, {fig(m, False)} AS prior FROM filed GROUP BY doc, fy" for n, m in ITEMS_SQL))
def grid_line_item(spark, sf_dir):
    return items.income_statement(staged(render.statement_grid, spark, sf_dir), ["doc", "fy"])


@query("grid_segment_item", FILINGS + """
, segs(segment) AS (VALUES ('Health'), ('Personal Accident'), ('Travel'))""" + " UNION ALL ".join(
    f" SELECT d.doc, d.fy, s.segment, '{n}' AS item, {fig(m, True)} AS cur, {fig(m, False)} AS prior FROM docs d CROSS JOIN segs s"
    " LEFT JOIN filed x ON x.doc = d.doc AND x.fy = d.fy AND x.segment = s.segment GROUP BY d.doc, d.fy, s.segment" for n, m in ITEMS_SQL))
def grid_segment_item(spark, sf_dir):
    return items.segment_statement(staged(render.statement_grid, spark, sf_dir), ["doc", "fy"], fixed.SEGMENT_SPELLINGS)


@query("grid_group_sum", FILINGS + f""", s AS (
SELECT doc, fy, {fig('claims', True)} AS a, {fig('commission', True)} AS b, {fig('opex', True)} AS c,
  {fig('claims', False)} AS x, {fig('commission', False)} AS y, {fig('opex', False)} AS z FROM filed GROUP BY doc, fy)
SELECT doc, fy, 1 AS page, 0 AS tbl, CAST(CAST(a AS DECIMAL(24,4)) + CAST(b AS DECIMAL(24,4)) + CAST(c AS DECIMAL(24,4)) AS DOUBLE) AS cur,
  CAST(CAST(x AS DECIMAL(24,4)) + CAST(y AS DECIMAL(24,4)) + CAST(z AS DECIMAL(24,4)) AS DOUBLE) AS prior FROM s""")
def grid_group_sum(spark, sf_dir):
    rows = staged(render.statement_grid, spark, sf_dir)
    return grid.sum_after_in_blocks(rows, grid.resolved_rows(rows, KEYS, by=KEYS, blocks=True), KEYS, ["Claims Incurred"], "^Profit", include_anchor=True)


@query("grid_headers", FILINGS + """
SELECT doc % 5 AS layout, kind, period, filled, count(*) AS headers FROM docs,
 (VALUES ('cumulative', 'current'), ('quarter', 'current'), ('cumulative', 'prior'), ('quarter', 'prior')) k(kind, period),
 (VALUES (false), (true), (true), (true)) t(filled) GROUP BY ALL""")
def grid_headers(spark, sf_dir):
    heads = grid.period_headers(staged(render.statement_grid, spark, sf_dir), KEYS)
    return heads.groupBy((F.col("doc") % 5).alias("layout"), "kind", "period", "filled").agg(F.count("*").alias("headers"))


@query("grid_decorative", FILINGS + """
SELECT doc, fy, CASE WHEN doc % 5 = 2 THEN 1 ELSE 0 END AS decorative FROM docs""")
def grid_decorative(spark, sf_dir):
    rows = staged(render.statement_grid, spark, sf_dir)
    caption = grid.is_decorative(F.col("cells")) & grid.mentions(F.col("cells"), ["revenue account"], ["premium"])
    return rows.groupBy("doc", "fy").agg(F.count_if(caption).cast("int").alias("decorative"))


@query("grid_snapshot", FILINGS + f"""
SELECT doc, fy, 'capital' AS item, nullif({fig('gross', True)}, 0) AS cur, nullif({fig('gross', False)}, 0) AS prior FROM filed GROUP BY doc, fy
UNION ALL SELECT doc, fy, 'application', nullif({fig('accepted', True)}, 0), nullif({fig('accepted', False)}, 0) FROM filed GROUP BY doc, fy""")
def grid_snapshot(spark, sf_dir):
    rows = staged(render.balance_grid, spark, sf_dir).where(F.col("page") == 4)
    return grid.snapshot_items(rows, KEYS, {"capital": ["SHARE CAPITAL"], "application": ["SHARE APPLICATION MONEY"]}).drop("page", "tbl")


def premium_sql(now):
    return (f"CASE WHEN doc % 2 = 1 THEN {fig('gross', now)} ELSE CAST(CAST({fig('value', now)} AS DECIMAL(24,4)) + CAST({fig('commission', now)} AS DECIMAL(24,4))"
            f" - CAST({fig('ceded', now)} AS DECIMAL(24,4)) AS DOUBLE) END")


@query("share_premium", FILINGS + f" SELECT doc, fy, {premium_sql(True)} AS cur, {premium_sql(False)} AS prior FROM filed GROUP BY doc, fy")
def share_premium(spark, sf_dir):
    return items.share_premium(staged(render.balance_grid, spark, sf_dir).where(F.col("page") == 5), KEYS).drop("page", "tbl")


def capital_sql(now):
    return (f"CAST(round(CAST(CAST(nullif({fig('gross', now)}, 0) AS DECIMAL(24,4)) + CAST({fig('accepted', now)} AS DECIMAL(24,4))"
            f" + CAST({premium_sql(now)} AS DECIMAL(24,4)) AS DECIMAL(24,4)) * CAST(0.01 AS DECIMAL(4,2)), 2) AS DOUBLE)")


@query("cumulative_capital", FILINGS + f" SELECT doc, fy, {capital_sql(True)} AS cur, {capital_sql(False)} AS prior FROM filed GROUP BY doc, fy")
def cumulative_capital(spark, sf_dir):
    rows = staged(render.balance_grid, spark, sf_dir)
    balance = grid.snapshot_items(rows.where(F.col("page") == 4), KEYS, {"capital": ["SHARE CAPITAL"], "application": ["SHARE APPLICATION MONEY"]})
    premium = items.share_premium(rows.where(F.col("page") == 5), KEYS)
    return items.cumulative_capital(balance, premium, ["doc", "fy"])


BUCKET = ("CASE WHEN left(channel, 1) = '1' THEN 'Individual Agents' WHEN left(channel, 1) = '2' THEN 'Corporate Agents - Banks' "
          "WHEN left(channel, 1) = '3' THEN 'Corporate Agents - Others' WHEN left(channel, 1) = '5' THEN 'Direct Business' "
          "WHEN flag = 'R' THEN 'Others' ELSE 'Brokers' END")


@query("grid_channel_form", FILINGS + f"""
, b AS (SELECT *, {BUCKET} AS bucket FROM filed)
, names(bucket) AS (VALUES ('Individual Agents'), ('Corporate Agents - Banks'), ('Corporate Agents - Others'), ('Brokers'), ('Direct Business'), ('Others'))
SELECT d.doc, d.fy, n.bucket, {fig('gross', True)} AS cur, {fig('gross', False)} AS prior FROM docs d CROSS JOIN names n
LEFT JOIN b ON b.doc = d.doc AND b.fy = d.fy AND b.bucket = n.bucket GROUP BY d.doc, d.fy, n.bucket
UNION ALL SELECT doc, fy, t.bucket, {fig('gross', True)}, {fig('gross', False)} FROM filed, (VALUES ('Total (A)'), ('Grand Total')) t(bucket) GROUP BY doc, fy, t.bucket""")
def grid_channel_form(spark, sf_dir):
    rows = staged(render.channel_grid, spark, sf_dir)
    cols = grid.channel_columns(rows, KEYS, "premium")
    return grid.channel_rows(rows, KEYS, cols, fixed.CHANNEL_FRAGMENTS).drop("page", "tbl")


@query("grid_total_policies", FILINGS + f" SELECT doc, fy, {fig('lines', True)} AS cur, {fig('lines', False)} AS prior FROM filed GROUP BY doc, fy")
def grid_total_policies(spark, sf_dir):
    rows = staged(render.channel_grid, spark, sf_dir)
    cols = grid.channel_columns(rows, KEYS, "policies")
    totals = grid.channel_rows(rows, KEYS, cols, {}).where(F.col("bucket").isin("Grand Total", "Total (A)"))
    rank = F.when(F.col("bucket") == "Grand Total", 0).otherwise(1)
    return totals.groupBy("doc", "fy").agg(F.min_by(F.struct("cur", "prior"), rank).alias("v")).select("doc", "fy", "v.cur", "v.prior")


@query("channel_column_issues", FILINGS + " SELECT doc, fy, doc % 7 = 0 AS by_order FROM docs")
def channel_column_issues(spark, sf_dir):
    return grid.channel_columns(staged(render.channel_grid, spark, sf_dir), KEYS).select("doc", "fy", "by_order")


@query("grid_blocks", FILINGS + """
, n AS (SELECT doc, fy, now, q = (doc // 3) % 4 + 1 AS last, CAST(SUM(CASE WHEN status = 'O' THEN lines ELSE 0 END) AS DOUBLE) AS n, flag, SUM(claims) AS a FROM filed GROUP BY ALL)
, t AS (SELECT doc, fy, flag, SUM(n) FILTER (now) AS n, round(SUM(a) FILTER (now), 2) AS a FROM n GROUP BY ALL)
, y AS (SELECT doc, fy, SUM(n) AS claims, CAST(SUM(a) FILTER (n > 0) AS DOUBLE) AS amount FROM t GROUP BY ALL)
SELECT doc, fy, claims, amount, round(amount * 1e5::DOUBLE / claims, 2) AS claim_size FROM y WHERE claims > 0""")
def grid_blocks(spark, sf_dir):
    claims = grid.claim_blocks(staged(render.claims_grid, spark, sf_dir), KEYS)
    return grid.average_claim(claims, KEYS).drop("page", "tbl")


@query("investment_yield", FILINGS + f"""
, s AS (SELECT doc, fy, {fig('gross', True)} AS g, {fig('commission', True)} AS c, {fig('gross', False)} AS gp, {fig('commission', False)} AS cp FROM filed GROUP BY doc, fy)
SELECT doc, fy, CASE WHEN doc % 3 <> 0 THEN round(c / nullif(g, 0) * 100, 2) / 100 ELSE round(nullif(c, 0) / nullif(g, 0), 4) END AS cur,
  CASE WHEN doc % 3 <> 0 THEN round(cp / nullif(gp, 0) * 100, 2) / 100 ELSE round(nullif(cp, 0) / nullif(gp, 0), 4) END AS prior FROM s""")
def investment_yield(spark, sf_dir):
    return items.investment_yield(staged(render.investment_grid, spark, sf_dir), KEYS).drop("page", "tbl")


CODES = render.INVESTMENT_CODES
CODE_ROWS = fixed.dimension_rows(fixed.CODE_BUCKETS)
CODE_SQL = ("CASE partkey % 10 " + " ".join(f"WHEN {i} THEN '{dict(CODE_ROWS)[c]}'" for i, c in enumerate(CODES) if c != "ZZZZ") + " END")


@query("investment_portfolio", FILINGS + f"""
, p AS (SELECT doc, fy, partkey % 10 AS code, {CODE_SQL} AS bucket, round(SUM(gross) FILTER (now), 2) AS c, round(SUM(gross) FILTER (NOT now), 2) AS p FROM filed GROUP BY ALL)
SELECT doc, fy, bucket, CAST(round(CAST(SUM(nullif(c, 0)) AS DECIMAL(24,4)) * CAST(0.01 AS DECIMAL(4,2)), 2) AS DOUBLE) AS cur,
  CAST(round(CAST(SUM(nullif(p, 0)) AS DECIMAL(24,4)) * CAST(0.01 AS DECIMAL(4,2)), 2) AS DOUBLE) AS prior FROM p
WHERE bucket IS NOT NULL GROUP BY ALL""")
def investment_portfolio(spark, sf_dir):
    codes = items.investment_codes(staged(render.investment_grid, spark, sf_dir), KEYS)
    buckets = spark.createDataFrame(CODE_ROWS, "code string, bucket string")
    return items.investment_portfolio(codes, KEYS, buckets)[0].drop("page", "tbl")


@query("investment_unknown_codes", FILINGS + f"""
SELECT doc, fy, 'ZZZZ' AS code, nullif({fig('gross', True)}, 0) AS cur, nullif({fig('gross', False)}, 0) AS prior FROM filed WHERE partkey % 10 = 8 GROUP BY doc, fy""")
def investment_unknown_codes(spark, sf_dir):
    codes = items.investment_codes(staged(render.investment_grid, spark, sf_dir), KEYS)
    buckets = spark.createDataFrame(CODE_ROWS, "code string, bucket string")
    return items.investment_portfolio(codes, KEYS, buckets)[1].drop("page", "tbl")


def small(m, s, f):
    return fig(m, True, f"status = '{s}' AND flag = '{f}'")


@query("it_capex", FILINGS + f"""
SELECT doc, fy, CAST(CAST({small('gross', 'O', 'A')} AS DECIMAL(24,4)) + CAST({small('gross', 'F', 'A')} AS DECIMAL(24,4)) AS DOUBLE) AS value
FROM filed GROUP BY doc, fy""")
def it_capex(spark, sf_dir):
    return items.it_additions(staged(render.small_forms, spark, sf_dir).where(F.col("page") == 7), ["doc", "fy"])


@query("office_counts", FILINGS + f" SELECT doc, fy, {small('lines', 'O', 'A')} AS opening, {small('lines', 'F', 'A')} AS closing FROM filed GROUP BY doc, fy")
def office_counts(spark, sf_dir):
    rows = staged(render.small_forms, spark, sf_dir).where(F.col("page") == 8)
    counts = items.labelled_counts(rows, ["doc", "fy"], items.OFFICE_PATTERNS)
    zero = F.lit(0.0)
    return counts.select("doc", "fy", F.coalesce("opening", zero).alias("opening"), F.coalesce("closing", zero).alias("closing"))


@query("on_roll_count", FILINGS + f", s AS (SELECT doc, fy, {fig('lines', True)} AS value FROM filed GROUP BY doc, fy) SELECT * FROM s WHERE value > 0")
def on_roll_count(spark, sf_dir):
    return items.on_roll(staged(render.small_forms, spark, sf_dir).where(F.col("page") == 8), ["doc", "fy"])


@query("complaint_ratios", FILINGS + f"""
, s AS (SELECT doc, fy, '6' AS item, {small('gross', 'O', 'N')} AS value FROM filed GROUP BY doc, fy UNION ALL SELECT doc, fy, '7', {small('gross', 'F', 'N')} FROM filed GROUP BY doc, fy)
SELECT * FROM s WHERE value <> 0""")
def complaint_ratios(spark, sf_dir):
    rows = staged(render.small_forms, spark, sf_dir).where(F.col("page") == 9)
    return items.numbered_items(rows, ["doc", "fy"], ["6", "7"], r"(?i)per\s*10,?000")


@query("claims_count", FILINGS + f", s AS (SELECT doc, fy, '5' AS item, {small('lines', 'O', 'N')} AS value FROM filed GROUP BY doc, fy) SELECT * FROM s WHERE value <> 0")
def claims_count(spark, sf_dir):
    rows = staged(render.small_forms, spark, sf_dir).where(F.col("page") == 9)
    return items.numbered_items(rows, ["doc", "fy"], ["5"], r"(?i)no\.?\s*of\s*claims\s*during")


@query("claims_movement", FILINGS + f"""
, s AS (SELECT doc, fy, {small('gross', 'O', 'N')} AS os_start, CAST(CAST({small('gross', 'O', 'A')} AS DECIMAL(24,4)) + CAST({small('gross', 'F', 'A')} AS DECIMAL(24,4)) AS DOUBLE) AS reported,
  {small('gross', 'F', 'N')} AS settled, {small('gross', 'O', 'R')} AS os_end FROM filed GROUP BY doc, fy)
SELECT doc, fy, CAST(1 AS BIGINT) AS block, os_start, reported, settled, os_end, round(settled / nullif(os_start + reported - os_end, 0), 4) AS csr FROM s""")
def claims_movement(spark, sf_dir):
    rows = staged(render.small_forms, spark, sf_dir).where(F.col("page") == 10)
    lines = rows.select(*KEYS, "r", F.get("cells", F.lit(0)).alias("label"), printed_number(F.get("cells", F.lit(1))).alias("value"))
    return items.claim_movement(lines, KEYS).drop("page", "tbl")


TIDY_SQL = " UNION ALL ".join(
    f"SELECT doc, fy, '{label}' AS label, grp, {fig(m, True)} AS c, {fig(m, False)} AS p, bool_or(now) AS n, bool_or(NOT now) AS l FROM g GROUP BY doc, fy, grp"
    for label, m in render.GRID_ITEMS)


@query("grid_tidy", FILINGS + f"""
, g AS (SELECT *, segment AS grp FROM filed UNION ALL SELECT *, 'Total' FROM filed)
, t AS ({TIDY_SQL})
SELECT doc, fy, label, grp, CASE WHEN n THEN c END AS cur, CASE WHEN doc % 5 <> 3 OR l THEN p END AS prior FROM t WHERE n OR doc % 5 = 3""")
def grid_tidy(spark, sf_dir):
    out = grid.tidy(staged(render.statement_grid, spark, sf_dir), KEYS).where(F.col("label") != "Gross Direct Premium :")
    figure = lambda c: F.when(F.col(c).isNotNull(), printed_number(F.col(c)))
    return out.select("doc", "fy", "label", "grp", figure("cur_text").alias("cur"), figure("prior_text").alias("prior"))


@query("form_pages", FILINGS + """
, p AS (SELECT doc, fy, CASE WHEN g % 2 = 0 THEN 'even' ELSE 'odd' END AS form, CAST(g AS INTEGER) AS page FROM docs, range(4, 11) t(g) WHERE g NOT IN (6))
SELECT doc, fy, form, page, row_number() OVER (PARTITION BY doc, fy, form ORDER BY page) <= 2 AS kept FROM p""")
def form_pages(spark, sf_dir):
    rows = staged(render.balance_grid, spark, sf_dir).unionByName(staged(render.small_forms, spark, sf_dir))
    pages = rows.select("doc", "fy", "page").distinct().withColumn("form", F.when(F.col("page") % 2 == 0, "even").otherwise("odd"))
    return grid.first_pages(pages, ["doc", "fy", "form"])




@query("filing_json", FILINGS + " UNION ALL ".join(
    f" SELECT doc, fy, '{n}' AS item, {fig(m, True)} AS cur, {fig(m, False)} AS prior FROM filed GROUP BY doc, fy" for n, m in ITEMS_SQL))
def filing_json(spark, sf_dir):
    # the same statements stored as nested documents, read back and flattened
    rows = render.statement_grid(spark, sf_dir).withColumn("company", F.concat_ws("/", "doc", "fy"))
    path = f"{shared_dir(spark).rstrip('/')}/peerlens/filings-{uuid.uuid4().hex}"
    filings.nest(rows, "company").write.json(path, compression="gzip")
    stored = filings.table_rows(filings.read_filings(spark, path), "company")
    part = lambda n: F.split_part("company", F.lit("/"), F.lit(n))
    stored = grid.pages_with_form(stored, "NL-1").select(
        part(1).cast("bigint").alias("doc"), part(2).cast("int").alias("fy"), "page", "tbl", "r", "cells")
    stored = stored.withColumn("quarter", render.filing_quarter())
    return items.income_statement(stored, ["doc", "fy"])


@query("gross_or_components", FILINGS + f"""
, s AS (SELECT doc, fy, {fig('accepted', True)} AS g, {fig('accepted', False)} AS gp, {fig('commission', True)} AS c, {fig('commission', False)} AS cp,
   {fig('opex', True)} AS o, {fig('opex', False)} AS op FROM filed GROUP BY doc, fy)
SELECT doc, fy, CASE WHEN g = 0 AND gp = 0 THEN CAST(CAST(c AS DECIMAL(24,4)) + CAST(o AS DECIMAL(24,4)) AS DOUBLE) ELSE g END AS cur,
  CASE WHEN g = 0 AND gp = 0 THEN CAST(CAST(cp AS DECIMAL(24,4)) + CAST(op AS DECIMAL(24,4)) AS DOUBLE) ELSE gp END AS prior FROM s""")
def gross_or_components(spark, sf_dir):
    found = items.income_statement(staged(render.statement_grid, spark, sf_dir), ["doc", "fy"])
    return items.gross_or_components(found, ["doc", "fy"], "Accepted", ["Commission", "Operating Expenses"])

"""Tables that do not say which column is which: columns found by their figures, and the log of what was not found."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed_values as fixed
from ..functions.numbers import printed_number
from ..operators import fill, grid, items
from ..sources import block_sheet, registry
from ..sources.tables import read_table
from . import render_plain as render
from .queries_grid import BUCKET, CODE_ROWS, CODE_SQL, FILINGS, KEYS, fig
from .queries_sheets import KEYS as SHEET_KEYS
from .queries_sheets import SHEETS
from .registry import query, staged
from .render_filings import INVESTMENT_CODES, channel_grid
from .render_sheets import block_sheets

GROUPS = {"Number": "lines", "Amount": "gross"}


@query("resolved_without_header", FILINGS + """
, segs(segment) AS (VALUES ('Health'), ('Personal Accident'), ('Travel'))
, told AS (""" + " UNION ALL ".join(
    f"SELECT d.doc, d.fy, s.segment || ' audited' AS label, '{g}' AS grp, {fig(m, True)} AS value FROM docs d CROSS JOIN segs s"
    " LEFT JOIN filed x ON x.doc = d.doc AND x.fy = d.fy AND x.segment = s.segment GROUP BY d.doc, d.fy, s.segment" for g, m in GROUPS.items()) + """)
SELECT doc, fy, label, grp, value, CAST(NULL AS VARCHAR) AS reason FROM told WHERE doc % 6 < 4
UNION ALL SELECT doc, fy, NULL, NULL, NULL, CASE doc % 6 WHEN 4 THEN 'no header row names a column' ELSE 'no column of figures under the header' END
FROM docs WHERE doc % 6 >= 4""")
def resolved_without_header(spark, sf_dir):
    rows = staged(render.plain_grid, spark, sf_dir)
    told = grid.tidy(rows, KEYS, grid.resolve_every_table).select(
        "doc", "fy", "label", "grp", printed_number(F.col("cur_text")).alias("value"), F.lit(None).cast("string").alias("reason"))
    # tables that are told nothing of
    none = lambda t: F.lit(None).cast(t)
    lost = grid.inferred_columns(rows, KEYS).where(F.col("reason").isNotNull()).select(
        "doc", "fy", none("string").alias("label"), none("string").alias("grp"), none("double").alias("value"), "reason")
    return told.unionByName(lost)


@query("grid_issues", FILINGS + """
, faults(k, page, op, reason) AS (VALUES
  (0, 15, 'value columns', 'no column of figures under the header'), (1, 12, 'cumulative columns', 'no header names the cumulative columns'),
  (2, 13, 'closing dates', 'no header names both dates: last two columns taken'),
  (3, 14, 'channel blocks', 'no usable years: blocks taken in reading order'), (4, 15, 'value columns', 'a period column has no group'))
SELECT doc, fy, page, 0 AS tbl, op, reason FROM docs JOIN faults ON doc % 5 = k""")
def grid_issues(spark, sf_dir):
    rows = staged(render.faulty_grid, spark, sf_dir)
    page = lambda n: rows.where(F.col("page") == n)
    return grid.table_issues({
        "cumulative columns": grid.anchor_reasons(page(12), KEYS), "closing dates": grid.snapshot_columns(page(13), KEYS),
        "channel blocks": grid.channel_columns(page(14), KEYS), "value columns": grid.resolve_every_table(page(15), KEYS)}, KEYS)


CODE_NAME = "CASE partkey % 10 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(INVESTMENT_CODES)) + " END"


@query("portfolio_reconciled", FILINGS + f"""
, v AS (SELECT doc, fy, now, {CODE_NAME} AS code, {CODE_SQL} AS bucket, nullif(CAST(round(SUM(gross), 2) AS DECIMAL(18,2)), 0) AS value FROM filed GROUP BY ALL)
, t AS (SELECT doc, fy, now, coalesce(SUM(value) FILTER (bucket IS NOT NULL), 0) AS known, coalesce(SUM(value) FILTER (bucket IS NULL), 0) AS unknown, SUM(value) AS total FROM v GROUP BY ALL)
, p AS (SELECT doc, fy, now, CAST(known AS DECIMAL(18,2)) AS known, CAST(unknown AS DECIMAL(18,2)) AS unknown, CASE doc % 4 WHEN 0 THEN CAST(total AS DECIMAL(18,2))
  WHEN 1 THEN CAST(round(CAST(total AS DECIMAL(18,2)) * CAST(1.004 AS DECIMAL(4,3)), 2) AS DECIMAL(18,2)) WHEN 2 THEN CAST(round(CAST(total AS DECIMAL(18,2)) * CAST(1.006 AS DECIMAL(4,3)), 2) AS DECIMAL(18,2)) END AS printed FROM t)
SELECT doc, fy, CASE WHEN now THEN 'current' ELSE 'prior' END AS period, code, bucket, CAST(value AS DOUBLE) AS value, CAST(known AS DOUBLE) AS known,
  CAST(unknown AS DOUBLE) AS unknown, CAST(printed AS DOUBLE) AS printed, CASE WHEN coalesce(printed, 0) = 0 THEN 'no total'
  WHEN abs(known - printed) * 200 <= printed THEN 'agrees' WHEN abs(known + unknown - printed) * 200 <= printed THEN 'agrees with unknown codes' ELSE 'differs' END AS status
FROM v JOIN p USING (doc, fy, now) WHERE value IS NOT NULL""")
def portfolio_reconciled(spark, sf_dir):
    buckets = spark.createDataFrame(CODE_ROWS, "code string, bucket string")
    return items.portfolio_audit(staged(render.misprinted_portfolio, spark, sf_dir), KEYS, buckets).drop("page", "tbl")


PREMIUM_CHANNELS = [*fixed.CHANNEL_FRAGMENTS, "Others"]


@query("channel_commission_rate", FILINGS + f"""
, b AS (SELECT *, {BUCKET} AS bucket FROM filed)
, names(bucket) AS (VALUES {", ".join(f"('{c}')" for c in PREMIUM_CHANNELS)})
, s AS (SELECT d.doc, d.fy, n.bucket, {fig('commission', True)} AS cur, {fig('commission', False)} AS prior, {fig('gross', True)} AS c, {fig('gross', False)} AS p
  FROM docs d CROSS JOIN names n LEFT JOIN b ON b.doc = d.doc AND b.fy = d.fy AND b.bucket = n.bucket GROUP BY d.doc, d.fy, n.bucket)
SELECT doc, fy, bucket, cur, prior, round(cur / nullif(c, 0), 4) AS cur_rate, round(prior / nullif(p, 0), 4) AS prior_rate FROM s""")
def channel_commission_rate(spark, sf_dir):
    form = staged(channel_grid, spark, sf_dir)
    premium = grid.channel_rows(form, KEYS, grid.channel_columns(form, KEYS), fixed.CHANNEL_FRAGMENTS).drop("page", "tbl")
    schedule = staged(render.commission_grid, spark, sf_dir)
    commission = grid.line_items(
        grid.resolved_rows(schedule, KEYS, total=False), ["doc", "fy"], {c: [[c]] for c in render.COMMISSION_CHANNELS}, ["page", "tbl", "r"])
    spellings = spark.createDataFrame(list(zip(render.COMMISSION_CHANNELS, PREMIUM_CHANNELS)), "item string, bucket string")
    return fill.rate_across(commission, premium, spellings, ["doc", "fy"], "item", "bucket")


@query("entity_grand_totals", SHEETS + """
SELECT sheet, fy, q, 'Peer ' || n_nationkey AS entity, cur, prev AS prior FROM sheet JOIN nation ON label = n_name
WHERE col = 'Grand Total' AND coalesce(cur, prev) IS NOT NULL""")
def entity_grand_totals(spark, sf_dir):
    sheet = block_sheet.read_block_sheet(staged(block_sheets, spark, sf_dir), SHEET_KEYS)
    labels = read_table(spark, sf_dir, "nation").select(F.concat(F.lit("Peer "), "n_nationkey").alias("entity"), F.col("n_name").alias("label"))
    return block_sheet.entity_totals(sheet, labels, SHEET_KEYS)


@query("short_keys", """
SELECT s_name || ' & Allied' AS name, CASE WHEN s_suppkey % 5 = 0 THEN NULL WHEN s_suppkey % 3 = 0 THEN 'Another & ' || s_suppkey ELSE 'Short ' || s_suppkey END AS short_key,
  CASE WHEN s_suppkey % 5 = 0 THEN replace(replace(lower(s_name || ' & Allied'), ' ', '-'), '&', 'and')
    WHEN s_suppkey % 3 = 0 THEN 'another-and-' || s_suppkey ELSE 'short-' || s_suppkey END AS entity_slug FROM supplier""")
def short_keys(spark, sf_dir):
    # every third document is kept under two keys, every fifth source has none
    named = read_table(spark, sf_dir, "supplier").select("s_suppkey", F.concat("s_name", F.lit(" & Allied")).alias("name"))
    file = F.concat(F.replace(F.split_part("name", F.lit(" &"), F.lit(1)), F.lit(" "), F.lit("_")), F.lit("_and_Allied.pdf"))
    keys = F.array_compact(F.array(
        F.concat(F.lit("Short "), "s_suppkey"), F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("Another & "), "s_suppkey"))))
    entities = named.where(F.col("s_suppkey") % 5 != 0).select(file.alias("file_name"), F.explode(keys).alias("short_key"))
    return registry.short_keys(named.select("name"), entities)

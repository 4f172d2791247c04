"""Workbook reading queries: rendered sheets read back, compared with plain aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import canonical_entity
from ..operators import industry
from ..sources import block_sheet, history
from ..sources.tables import read_table
from .queries_series import HISTORY
from .queries_series import history as long_history
from .registry import paired_sql, panel_sql, query, staged
from .panel import years as span
from .render_sheets import SEGMENT_COLUMNS, block_sheets, history_books

KEYS = ["sheet", "fy", "q"]
COLS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SEGMENT_COLUMNS.items())
D = "CAST(SUM(CAST({0} AS DECIMAL(38,4))) AS DOUBLE)"
SHEETS = paired_sql("grp, entity, segment, q", "value, gross") + f"""
, long AS (SELECT 'segment' AS sheet, grp, entity, segment, fy, q, value AS cur, value_prior AS prev FROM pairs
   UNION ALL SELECT 'health', grp, entity, segment, fy, q, gross, gross_prior FROM pairs)
, sums AS (SELECT sheet, fy, q, grp, entity, segment, GROUPING(grp) AS gg, GROUPING(entity) AS ge, GROUPING(segment) AS gs,
   {D.format('cur')} AS cur, {D.format('prev')} AS prev FROM long
   GROUP BY GROUPING SETS ((sheet, fy, q, grp, entity, segment), (sheet, fy, q, grp, entity), (sheet, fy, q, grp, segment),
     (sheet, fy, q, grp), (sheet, fy, q, segment), (sheet, fy, q)))
, sheet AS (SELECT sheet, fy, q, CASE WHEN gg = 1 THEN 'Industry Total' WHEN ge = 1 THEN grp || ' sub Total' ELSE entity END AS label,
   CASE WHEN gs = 1 THEN 'Grand Total' ELSE CASE segment {COLS} END END AS col, cur, prev FROM sums)
, grid AS (SELECT sheet, fy, q, label, col, cur, prev FROM (SELECT DISTINCT sheet, fy, q, label FROM sheet) l
   CROSS JOIN (SELECT DISTINCT col FROM sheet) c LEFT JOIN sheet s USING (sheet, fy, q, label, col))"""


@query("block_sheet", SHEETS + " SELECT * FROM grid")
def read_block_sheet(spark, sf_dir):
    return block_sheet.read_block_sheet(staged(block_sheets, spark, sf_dir), KEYS)


@query("block_sheet_market_share", SHEETS + """
, t AS (SELECT * FROM sheet WHERE label = 'Industry Total')
SELECT a.sheet, a.fy, a.q, a.col, a.cur / b.cur AS cur, a.prev / nullif(b.prev, 0) AS prev FROM t a
JOIN t b ON a.sheet = b.sheet AND a.fy = b.fy AND a.q = b.q AND b.col = 'Grand Total'""")
def read_market_share(spark, sf_dir):
    return block_sheet.read_market_share(staged(block_sheets, spark, sf_dir), KEYS)


WANTED = ["Fire", "Marine Cargo", "Health", "Crop"]


@query("sheet_column_lookup", SHEETS + """
SELECT sheet, fy, q, CASE col WHEN 'Fire' THEN 'Fire' WHEN 'Health ' THEN 'Health' ELSE 'Marine Cargo' END AS name, cur, prev, false AS missing
FROM sheet WHERE label = 'Industry Total' AND col IN ('Fire', 'Health ', 'Marine  Cargo')
UNION ALL SELECT DISTINCT sheet, fy, q, 'Crop', CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), true FROM sheet""")
def sheet_column_lookup(spark, sf_dir):
    rows = staged(block_sheets, spark, sf_dir)
    wanted = rows.select(*KEYS).distinct().withColumn("name", F.explode(F.array(*[F.lit(n) for n in WANTED])))
    return block_sheet.lookup_columns(block_sheet.read_block_sheet(rows, KEYS), wanted, KEYS, "Industry Total")


PEERS = ["NATION_2", "NATION_7", "NATION_12", "NATION_17", "NATION_22"]
PUBLIC = ["NATION_0", "NATION_10"]
LAYOUT = industry.Layout(
    public=PUBLIC, peers=PEERS, general_subtotal="AFRICA sub Total", peer_subtotal="ASIA sub Total",
    special_subtotal="EUROPE sub Total", parts={"Retail": "Fire", "Group": "Marine  Cargo", "Govt.": "Health ", "Travel": "Aviation "})
IN_PEERS = "('NATION_2', 'NATION_7', 'NATION_12', 'NATION_17', 'NATION_22')"
G = "round((cur - prev) / nullif(prev, 0), 4)"


@query("industry_lookups", SHEETS + f"""
, m AS (
  SELECT sheet, fy, q, col, u.unit, u.sign, cur, prev FROM grid, LATERAL (SELECT unnest(CASE
     WHEN label IN {IN_PEERS} THEN [{{unit: 'SAHI', sign: 1}}, {{unit: label, sign: 1}}]
     WHEN label IN ('NATION_0', 'NATION_10') THEN [{{unit: 'Public', sign: 1}}, {{unit: 'Private', sign: -1}}]
     WHEN label = 'AFRICA sub Total' THEN [{{unit: 'Private', sign: 1}}]
     WHEN label = 'ASIA sub Total' THEN [{{unit: 'SAHI subtotal', sign: 1}}]
     WHEN label = 'EUROPE sub Total' THEN [{{unit: 'Specialized Insurer', sign: 1}}]
     WHEN label = 'Industry Total' THEN [{{unit: 'Industry', sign: 1}}] END) AS u))
, u AS (SELECT fy, q, unit, part, CAST(SUM(sign * coalesce(CAST(cur AS DECIMAL(24,4)), 0)) AS DOUBLE) AS cur,
    CAST(SUM(sign * coalesce(CAST(prev AS DECIMAL(24,4)), 0)) AS DOUBLE) AS prev FROM (
    SELECT *, CASE WHEN sheet = 'segment' THEN CASE col WHEN 'P.A.' THEN 'PA' WHEN 'Grand Total' THEN 'All lines' END
      ELSE CASE col WHEN 'Fire' THEN 'Retail' WHEN 'Marine  Cargo' THEN 'Group' WHEN 'Health ' THEN 'Govt.' WHEN 'Aviation ' THEN 'Travel'
      WHEN 'Grand Total' THEN 'Health' END END AS part FROM m) WHERE part IS NOT NULL GROUP BY ALL)
, incl AS (SELECT fy, q, unit, {D.format('cur')} AS cur, {D.format('prev')} AS prev FROM u WHERE part IN ('Health', 'PA') GROUP BY ALL)
, mx AS (SELECT * FROM u WHERE part IN ('Retail', 'Group', 'Govt.', 'Travel', 'PA'))
, tot AS (SELECT fy, q, unit, {D.format('cur')} AS tc, {D.format('prev')} AS tp FROM mx GROUP BY ALL)
, sh AS (SELECT mx.*, CASE WHEN tc = 0 AND cur = 0 THEN 0 ELSE round(cur / nullif(tc, 0), 4) END AS sc,
     CASE WHEN tp = 0 AND prev = 0 THEN 0 ELSE round(prev / nullif(tp, 0), 4) END AS sp FROM mx JOIN tot USING (fy, q, unit))
SELECT fy, q, 3 AS slide, 'Industry' AS company, 'Market share' AS metric1, CASE unit WHEN 'SAHI subtotal' THEN 'SAHI' ELSE unit END AS metric2,
  CAST(round(CAST(cur AS DECIMAL(24,4)), 2) AS DOUBLE) AS cur, CAST(round(CAST(prev AS DECIMAL(24,4)), 2) AS DOUBLE) AS prior FROM u WHERE part = 'All lines' AND unit IN ('Private', 'Public', 'Specialized Insurer', 'SAHI subtotal')
UNION ALL SELECT fy, q, 3, 'Industry', 'Market share', col, CAST(round(CAST(coalesce(cur, 0) AS DECIMAL(24,4)), 2) AS DOUBLE), CAST(round(CAST(coalesce(prev, 0) AS DECIMAL(24,4)), 2) AS DOUBLE) FROM grid WHERE sheet = 'segment' AND label = 'Industry Total' AND col <> 'Grand Total'
UNION ALL SELECT fy, q, 4, 'Health Industry', 'Market share', unit, CAST(round(CAST(cur AS DECIMAL(24,4)), 2) AS DOUBLE), CAST(round(CAST(prev AS DECIMAL(24,4)), 2) AS DOUBLE) FROM incl WHERE unit IN ('Private', 'Public', 'SAHI')
UNION ALL SELECT fy, q, 4, 'Health Industry', 'Market share', part, CAST(round(CAST(cur AS DECIMAL(24,4)), 2) AS DOUBLE), CAST(round(CAST(prev AS DECIMAL(24,4)), 2) AS DOUBLE) FROM mx WHERE unit = 'Industry'
UNION ALL SELECT fy, q, 5, 'SAHI Market', 'Market share', unit, CAST(round(CAST(cur AS DECIMAL(24,4)), 2) AS DOUBLE), CAST(round(CAST(prev AS DECIMAL(24,4)), 2) AS DOUBLE) FROM incl WHERE unit IN {IN_PEERS}
UNION ALL SELECT fy, q, 6, unit, 'Market share', part, cur, prev FROM mx WHERE unit IN ('Private', 'Public', 'SAHI')
UNION ALL SELECT fy, q, 7, unit, 'Market share', part, cur, prev FROM mx WHERE unit IN {IN_PEERS}
UNION ALL SELECT fy, q, 8, 'Industry Total', 'Growth %', '', {G}, 0 FROM incl WHERE unit = 'Industry'
UNION ALL SELECT fy, q, 8, 'SAHI subtotal', 'Growth %', '', {G}, 0 FROM u WHERE unit = 'SAHI subtotal' AND part = 'All lines'
UNION ALL SELECT fy, q, 9, unit, 'SAHI Growth', 'GDPI Growth SAHI', {G}, NULL FROM incl WHERE unit = 'SAHI' OR unit IN {IN_PEERS}
UNION ALL SELECT fy, q, 10, 'Segment-wise GDPI mix', unit, part, cur, prev FROM mx WHERE unit IN ('Private', 'Public', 'Industry')
UNION ALL SELECT fy, q, 10, 'Segment-wise GDPI mix', unit, part, sc, sp FROM sh WHERE unit = 'SAHI'
UNION ALL SELECT fy, q, 11, 'Segment-wise GDPI mix - SAHI', unit, part, sc, sp FROM sh WHERE unit = 'SAHI' OR unit IN {IN_PEERS}
UNION ALL SELECT fy, q, 14, unit, 'Retail Revenue', '', cur, prev FROM u WHERE part = 'Retail' AND unit IN {IN_PEERS}
UNION ALL SELECT fy, q, 14, unit, 'Retail Accretion', 'Retail Revenue CY-Retail Revenue PY',
  CAST(round(CAST(cur AS DECIMAL(38,4)) - CAST(prev AS DECIMAL(38,4)), 2) AS DOUBLE), NULL FROM u WHERE part = 'Retail' AND unit IN {IN_PEERS}""")
def industry_lookups(spark, sf_dir):
    sheet = block_sheet.read_block_sheet(staged(block_sheets, spark, sf_dir), KEYS)
    return industry.slides(sheet, ["fy", "q"], LAYOUT)


def entity_of(label):
    return F.when(F.upper(label).startswith("NATION_"), F.upper(F.trim(label)))


@query("history_unpivot", panel_sql("segment, entity, fy", "value, gross, claims") + """
, t AS (SELECT segment, 'Value' AS title, entity, fy, value AS value FROM panel UNION ALL SELECT segment, 'Gross', entity, fy, gross FROM panel
   UNION ALL SELECT segment, 'Claims', entity, fy, claims FROM panel)
SELECT e.segment, e.title, e.entity, 'FY' || lpad(CAST((y + 1) % 100 AS VARCHAR), 2, '0') AS year_label, CAST((y + 1) % 100 AS INTEGER) AS fy_end, value
FROM (SELECT DISTINCT segment, title, entity FROM t) e CROSS JOIN (SELECT unnest(range(CAST(lo AS BIGINT), CAST(hi AS BIGINT) + 1)) AS y FROM (SELECT min(fy) AS lo, max(fy) AS hi FROM facts)) r
LEFT JOIN t ON t.segment = e.segment AND t.title = e.title AND t.entity = e.entity AND t.fy = y""")
def history_unpivot(spark, sf_dir):
    return history.read_history(staged(history_books, spark, sf_dir), ["segment"], entity_of)


def _appended(spark, sf_dir):
    years = long_history(spark, sf_dir)
    newest = span(spark, sf_dir)[1]  # ends the last complete year
    # gross was extended already; the claims figure of one entity is lost
    past = years.where((F.col("fy_end") < newest) | (F.col("title") == "gross")).where(F.col("fy_end") <= newest)
    lost = (F.col("title") == "claims") & (F.col("entity") == "NATION_4")
    point = years.where((F.col("fy_end") == newest) & ~lost)
    required = read_table(spark, sf_dir, "nation").select(F.col("n_name").alias("entity"))
    return history.append_year(past, point, required, newest, 4)


@query("append_year", HISTORY + """
SELECT title, entity, fy_end, value FROM history WHERE fy_end < (SELECT max(fy) FROM facts) OR (fy_end = (SELECT max(fy) FROM facts) AND title <> 'claims')""")
def append_year(spark, sf_dir):
    return _appended(spark, sf_dir)[0]


@query("append_year_skipped", HISTORY + """
SELECT 'claims' AS title, 'no value for a required entity' AS reason, count(*) AS missing FROM history
  WHERE title = 'claims' AND fy_end = (SELECT max(fy) FROM facts) AND entity = 'NATION_4'
UNION ALL SELECT 'gross', 'already has the year', 0""")
def append_year_skipped(spark, sf_dir):
    return _appended(spark, sf_dir)[1]


ALIASES = [("contains", "nation_1 ", "ONE"), ("contains", "nova", "TWO"), ("contains", "nation_2", "TWENTIES"),
           ("equals", "nation_3", "THREE"), ("contains", "nation", "NATION")]


@query("canonical_entity", """
SELECT c_custkey AS custkey, alias, CASE WHEN alias LIKE '%total%' THEN NULL WHEN a LIKE '%nation_2%' THEN 'TWENTIES' WHEN a = 'nation_3' THEN 'THREE'
  WHEN a LIKE '%nation_1 %' THEN 'ONE' WHEN a LIKE '%nation%' THEN 'NATION' END AS entity
FROM (SELECT *, lower(trim(alias)) AS a FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '  ' || n_name || ' Health Ltd' WHEN 1 THEN lower(n_name)
   WHEN 2 THEN n_name || ' & Allied' ELSE 'sub total' END AS alias FROM customer JOIN nation ON c_nationkey = n_nationkey))""")
def canonical_entity_query(spark, sf_dir):
    c = read_table(spark, sf_dir, "customer").join(read_table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    style = F.col("c_custkey") % 4
    alias = (
        F.when(style == 0, F.concat(F.lit("  "), "n_name", F.lit(" Health Ltd"))).when(style == 1, F.lower("n_name"))
        .when(style == 2, F.concat("n_name", F.lit(" & Allied"))).otherwise("sub total"))
    return c.select(F.col("c_custkey").alias("custkey"), alias.alias("alias"), canonical_entity(alias, ALIASES).alias("entity"))



"""Sources, routing and small value operators over the metric table, stored and read back where that is the point."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import numbers as num
from ..functions.periods import fiscal_quarter, fiscal_year, year_fragments
from ..functions.urls import monthly_path
from ..operators import fill, formulas, grid, report
from ..session import shared_dir
from ..sources import metric_table, registry
from ..sources.tables import read_table
from . import render_filings as render
from .fact_table import ROWS_SQL, metric_rows
from .panel import paired_panel
from .queries_grid import FILINGS
from .registry import FACTS, paired_sql, query, staged

ROWS = f"WITH {FACTS} {ROWS_SQL}"


def _folder(spark, name):
    return f"{shared_dir(spark).rstrip('/')}/peerlens/{name}-{uuid.uuid4().hex}"


@query("snapshot_round_trip", ROWS + " SELECT slide, company, metric1, metric2, fy, q, cur, prior FROM mrows")
def snapshot_round_trip(spark, sf_dir):
    """Two snapshots of every period, the older one with other figures and rows without a slide number."""
    rows, folder = metric_rows(spark, sf_dir), _folder(spark, "snapshots")
    older = rows.withColumn("cur", -F.col("cur")).withColumn("slide", F.col("slide").cast("string"))
    notes = older.where(F.col("company") == "NATION_1").withColumn("slide", F.concat("slide", F.lit("a")))
    for part, stamp in ((older.unionByName(notes), "20240101_000000"), (rows.withColumn("slide", F.col("slide").cast("string")).unionByName(notes), "20240201_000000")):
        metric_table.write_snapshot(part, folder, F.lit(stamp))
    newest = metric_table.newest_rows(spark, folder)
    return metric_table.numbered_slides(newest).select("slide", "company", "metric1", "metric2", "fy", "q", "cur", "prior")


@query("changed_labels", """
SELECT 'cur_' || o_orderpriority AS old, 'cur_' || c_mktsegment AS new FROM orders JOIN customer ON o_custkey = c_custkey
WHERE o_orderkey % 3 <> 0 GROUP BY ALL UNION SELECT NULL, 'cur_' || c_mktsegment FROM customer""")
def changed_labels(spark, sf_dir):
    both = read_table(spark, sf_dir, "orders").join(read_table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    old, new = F.concat(F.lit("cur_"), "o_orderpriority"), F.concat(F.lit("cur_"), "c_mktsegment")
    stored = both.select(F.when(F.col("o_orderkey") % 3 == 0, new).otherwise(old).alias("old"), new.alias("new"))
    unnamed = read_table(spark, sf_dir, "customer").select(F.lit(None).cast("string").alias("old"), new.alias("new"))
    return metric_table.changed_labels(stored.unionByName(unnamed), "old", "new")


@query("source_availability", """
SELECT s_name || ' & Sons' AS name, replace(lower(s_name), ' ', '-') || '-and-sons' AS slug,
  replace(s_name, ' ', '_') || '_and_Sons.' || CASE WHEN s_suppkey % 4 = 0 THEN 'xlsx' ELSE 'pdf' END AS file_name,
  CASE WHEN s_suppkey % 4 = 0 THEN 'xlsx' ELSE 'pdf' END AS file_type, s_suppkey % 3 <> 0 AS found FROM supplier""")
def source_availability(spark, sf_dir):
    """A registry object in JSON text, one per nation, read as rows and met with the files that exist."""
    suppliers = read_table(spark, sf_dir, "supplier")
    entry = F.struct(F.lit("https://example.org/a.pdf").alias("url"), F.when(F.col("s_suppkey") % 4 == 0, "xlsx").alias("file_type"))
    named = F.concat("s_name", F.lit(" & Sons"))
    objects = suppliers.groupBy("s_nationkey").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(named, entry)))).alias("value"))
    expected = registry.explode_sources(objects, "value")
    there = suppliers.where(F.col("s_suppkey") % 3 != 0).select(F.explode(F.array(*[
        F.concat(F.replace("s_name", F.lit(" "), F.lit("_")), F.lit(f"_and_Sons.{kind}")) for kind in ("pdf", "xlsx")])).alias("file_name"))
    return registry.availability(expected, there).select("name", "slug", "file_name", "file_type", "found")


@query("last_filled_number", """
SELECT o_orderkey AS okey, CASE o_orderkey % 4 WHEN 0 THEN round(o_totalprice, 2) WHEN 1 THEN -round(o_totalprice, 2)
  WHEN 2 THEN CAST(o_custkey AS DOUBLE) END AS value FROM orders""")
def last_filled_number(spark, sf_dir):
    price, none = F.format_number(F.round("o_totalprice", 2), 2), F.lit(None).cast("string")
    four = F.col("o_orderkey") % 4
    row = F.array(
        F.lit("label"), F.when(four < 3, F.col("o_custkey").cast("string")).otherwise("-"),
        F.when(four == 0, price).when(four == 1, F.concat(F.lit("("), price, F.lit(")"))).otherwise(" - "), F.lit("  "), none, F.lit("note"))
    return read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("okey"), num.last_filled_number(row).alias("value"))


@query("year_fragments", """
SELECT DISTINCT fy, q, CAST(y AS VARCHAR) AS whole, '-' || lpad(CAST(y % 100 AS VARCHAR), 2, '0') AS short FROM (
  SELECT fy, q, CASE WHEN q = 4 THEN fy + 1 ELSE fy END AS y FROM (
    SELECT CAST(year(o_orderdate - INTERVAL 3 MONTH) AS INTEGER) AS fy, CAST(quarter(o_orderdate - INTERVAL 3 MONTH) AS INTEGER) AS q FROM orders))""")
def year_fragments_query(spark, sf_dir):
    periods = read_table(spark, sf_dir, "orders").select(fiscal_year("o_orderdate").alias("fy"), fiscal_quarter("o_orderdate").alias("q")).distinct()
    parts = year_fragments(F.col("fy"), F.col("q"))
    return periods.select("fy", "q", F.get(parts, F.lit(0)).alias("whole"), F.get(parts, F.lit(1)).alias("short"))


@query("monthly_url", """
SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS y, 'https://example.org/m/Year_' || year(o_orderdate) || '/segment_' ||
  lower(monthname(o_orderdate)) || '_' || year(o_orderdate) || '.xlsx' AS url FROM orders""")
def monthly_url(spark, sf_dir):
    dates = read_table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("y"), F.date_format("o_orderdate", "MMMM").alias("month")).distinct()
    return dates.select("y", monthly_path("https://example.org/m/", F.col("month"), F.col("y")).alias("url"))


@query("numeric_values", """
SELECT o_orderkey AS okey, CASE o_orderkey % 5 WHEN 0 THEN o_totalprice WHEN 1 THEN CAST(o_custkey AS DOUBLE) END AS cur FROM orders""")
def numeric_values(spark, sf_dir):
    five = F.col("o_orderkey") % 5
    text = (F.when(five == 0, F.col("o_totalprice").cast("string")).when(five == 1, F.concat(F.lit(" "), "o_custkey"))
            .when(five == 2, "n.a.").when(five == 3, "NaN").otherwise(""))
    rows = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("okey"), text.alias("cur"))
    return metric_table.numeric_values(rows, ["cur"])


@query("header_rows", FILINGS + """
SELECT doc, fy, CAST(CASE doc % 5 WHEN 3 THEN CASE WHEN bool_or(now) THEN 2 ELSE 11 END WHEN 2 THEN 4 ELSE 3 END AS BIGINT) AS header_rows
FROM filed GROUP BY doc, fy""")
def header_rows(spark, sf_dir):
    return grid.header_row_count(staged(render.statement_grid, spark, sf_dir), ["doc", "fy"])


@query("candidates_first", """
SELECT host, page_id, CAST(place AS INTEGER) AS place FROM (
  SELECT regexp_extract(url, '^https?://([^/]*)', 1) AS host, page_id,
    row_number() OVER (PARTITION BY regexp_extract(url, '^https?://([^/]*)', 1) ORDER BY length(html) DESC, page_id) AS place FROM pages) WHERE place <= 8""")
def candidates_first(spark, sf_dir):
    pages = read_table(spark, sf_dir, "pages").select(
        F.regexp_extract("url", "^https?://([^/]*)", 1).alias("host"), "page_id", (-F.length("html")).alias("rank"))
    return fill.first_n(pages, ["host"], ["rank", "page_id"], 8).select("host", "page_id", "place")


# routing: figures under a key go to all rows of the report that show it
TARGETS = [("pbt", 26, "PBT", None), ("pbt", 31, "PBT", None), ("pbt", 18, "Profit", "PBT"), ("gwp", 31, "GWP", None), ("gwp", 18, "Gross Written Premium", None),
           ("aum", 36, "AUM", None), ("solvency", 35, "Solvency Ratio", None), ("employees", 38, "Employees", None)]
KINDS = {"pbt": "money", "gwp": "money", "aum": "money", "solvency": "ratio", "employees": "count"}
MEASURED = {"pbt": "value", "gwp": "gross", "aum": "claims", "solvency": "ceded", "employees": "quantity"}


@query("metric_targets", paired_sql("entity, q", ", ".join(MEASURED.values())) + ", routed AS (" + " UNION ALL ".join(
    f"SELECT entity, fy, q, {slide} AS slide, '{m1}' AS metric1, {repr(m2) if m2 else 'CAST(NULL AS VARCHAR)'} AS metric2, " + ", ".join(
        {"money": f"round({c} / 100, 2)", "ratio": f"round({c}, 4)", "count": f"round({c}, 0)"}[KINDS[k]] + f" AS {n}"
        for c, n in ((MEASURED[k], "cur"), (MEASURED[k] + "_prior", "prior"))) + " FROM pairs"
    for k, slide, m1, m2 in TARGETS) + ") SELECT * FROM routed")
def metric_targets(spark, sf_dir):
    p = paired_panel(spark, sf_dir, ["entity", "q", "fy"], list(MEASURED.values()))
    values = p.select("entity", "fy", "q", F.inline(F.array(*[
        F.struct(F.lit(k).alias("key"), F.lit(KINDS[k]).alias("kind"), F.col(m).alias("cur"), F.col(f"{m}_prior").alias("prior"))
        for k, m in MEASURED.items()])))
    targets = spark.createDataFrame(TARGETS, "key string, slide int, metric1 string, metric2 string")
    return formulas.to_targets(values, targets, ["entity", "fy", "q"])


PEERS = ["NATION_1", "NATION_2", "NATION_3"]
IN_PEERS = "(" + ", ".join(f"'{p}'" for p in PEERS) + ")"


@query("period_points", ROWS + f"""
, v AS (SELECT fy, q, company, cur, prior FROM mrows WHERE slide = 8)
, s AS (SELECT fy, q, company, cur, prior FROM v UNION ALL
  SELECT fy, q, 'Peers', CAST(SUM(CAST(cur AS DECIMAL(38,4))) AS DOUBLE), CAST(SUM(CAST(prior AS DECIMAL(38,4))) AS DOUBLE)
  FROM v WHERE company IN {IN_PEERS} GROUP BY fy, q)
SELECT fy, q, 'Premium' AS title, company, cur AS value FROM s WHERE cur IS NOT NULL
UNION ALL SELECT fy, q, 'Premium a year', company, cur * (12 / (q * 3)) FROM s WHERE cur IS NOT NULL
UNION ALL SELECT fy, q, 'Premium growth', company, round((cur - prior) / nullif(prior, 0), 4) FROM s WHERE prior IS NOT NULL AND prior <> 0""")
def period_points(spark, sf_dir):
    rows = metric_rows(spark, sf_dir).where(F.col("slide") == 8).withColumn("place", F.lit(1))
    doubled = rows.unionByName(rows.withColumns({"place": F.lit(2), "cur": F.lit(-1.0)}))  # a later row for every figure
    titles = [("Premium", 8, "Revenue Growth", "value"), ("Premium a year", 8, "Revenue Growth", "annual"), ("Premium growth", 8, "Revenue Growth", "growth")]
    listed = spark.createDataFrame(titles, "title string, slide int, metric1 string, kind string")
    return report.period_points(doubled, listed, ["fy", "q"], PEERS, "place")


@query("provenance_rows", ROWS + """
SELECT company, fy, q, 'value_' || slide || '_' || regexp_replace(lower(coalesce(metric2, '')), '[^a-z0-9]', '', 'g') AS key,
  CASE WHEN slide = 8 THEN 'derived' ELSE 'direct' END AS source, CASE slide WHEN 7 THEN 'NL-4' WHEN 8 THEN 'NL-1' ELSE 'NL-36' END AS source_form,
  CAST(slide + q AS INTEGER) AS page_number, cur, prior, cur IS NOT NULL AS found, slide, metric1, metric2 FROM mrows""")
def provenance_rows(spark, sf_dir):
    """Provenance stored as JSON per company, read back and flattened to one row per target."""
    rows, folder = metric_rows(spark, sf_dir), _folder(spark, "provenance")
    none = lambda t: F.lit(None).cast(t)
    form = F.when(F.col("slide") == 7, "NL-4").when(F.col("slide") == 8, "NL-1").otherwise("NL-36")
    fold = F.regexp_replace(F.lower(F.coalesce("metric2", F.lit(""))), "[^a-z0-9]", "")
    values = rows.select(
        "company", "fy", "q", F.concat_ws("_", F.lit("value"), "slide", fold).alias("key"), F.when(F.col("slide") == 8, "derived").otherwise("direct").alias("source"),
        F.lit("money").alias("kind"), "cur", "prior", F.col("cur").isNotNull().alias("found"), form.alias("source_form"),
        (F.col("slide") + F.col("q")).cast("int").alias("page_number"), none("string").alias("evidence"), none("string").alias("notes"), "slide", "metric1", "metric2")
    entries = metric_table.provenance(values, ["company", "fy", "q"])
    metric_table.write_provenance(entries, folder)
    stored = spark.read.schema(entries.schema).json(folder)
    flat = stored.select("company", "fy", "q", "entry.*").select("*", F.inline("target_rows"))
    return flat.select("company", "fy", "q", "key", "source", "source_form", "page_number", "cur", "prior", "found", "slide", "metric1", "metric2")

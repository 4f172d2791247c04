"""Growth, trend and ranking queries over the panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import adaptive_text, display_growth, growth, growth_label, indian_grouping
from ..functions.periods import (
    closing_date, fiscal_quarter, fiscal_year, fy_label, fy_label_long, fy_options, months_elapsed, period_column, period_ending_text,
    period_label, trend_label,
)
from ..operators import series
from ..operators.report import in_reports
from ..sources.tables import read_table
from .panel import UNIT, complete_years, order_rows, paired_panel, panel, report_periods, with_entity
from .registry import FACTS, paired_sql, panel_sql, query

GROWTH = "round((value - value_prior) / nullif(value_prior, 0), 4)"
TOTAL = "CAST(SUM(CAST({0} AS DECIMAL(38,4))) AS DOUBLE)"


@query("yoy_growth", paired_sql("entity, q") + f"""
, totals AS (SELECT fy, q, {TOTAL.format('value')} AS tc, {TOTAL.format('value_prior')} AS tp FROM pairs GROUP BY fy, q)
SELECT entity, fy, q, value, value_prior, {GROWTH} AS growth, value / nullif(tc, 0) AS share,
       value_prior / nullif(tp, 0) AS share_prior,
       (value / nullif(tc, 0) - value_prior / nullif(tp, 0)) * 100 AS share_change
FROM pairs JOIN totals USING (fy, q)""")
def yoy_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = paired_panel(spark, sf_dir, ["entity", "fy", "q"])
    return series.year_on_year(pairs, ["fy", "q"], "value", "value_prior")


@query("display_growth", paired_sql("entity, segment, q") + """
SELECT entity, segment, fy, q, CASE WHEN value_prior > 0 THEN value / value_prior - 1 END AS growth,
       CASE WHEN value_prior > 0 THEN
         (CASE WHEN value / value_prior - 1 >= 0 THEN '+' ELSE '' END)
         || CAST(CAST(round((value / value_prior - 1) * 100) AS BIGINT) AS VARCHAR) || '%' END AS label
FROM pairs""")
def display_growth_query(spark, sf_dir):
    pairs = paired_panel(spark, sf_dir, ["entity", "segment", "q", "fy"])
    g = display_growth(F.col("value"), F.col("value_prior"))
    return pairs.select("entity", "segment", "fy", "q", g.alias("growth"), growth_label(g).alias("label"))


@query("growth_not_meaningful", paired_sql("entity, segment, channel, q") + f"""
SELECT entity, segment, channel, fy, q, value, value_prior, {GROWTH} AS growth,
       CASE WHEN abs({GROWTH}) > 2 THEN 'NM' WHEN {GROWTH} IS NOT NULL THEN 'OK' END AS flag
FROM pairs""")
def growth_not_meaningful(spark, sf_dir):
    pairs = paired_panel(spark, sf_dir, ["entity", "segment", "channel", "q", "fy"])
    g = growth(F.col("value"), F.col("value_prior"))
    return pairs.withColumn("growth", g).withColumn("flag", series.not_meaningful(F.col("growth")))


@query("growth_consistency", paired_sql("entity, channel, q") + f"""
SELECT entity, channel, fy, q, {GROWTH} AS stored, round(value / nullif(value_prior, 0) - 1, 4) AS recomputed,
       abs({GROWTH} - (value / nullif(value_prior, 0) - 1)) > 0.0001 AS differs
FROM pairs WHERE value_prior IS NOT NULL""")
def growth_consistency(spark, sf_dir):
    pairs = paired_panel(spark, sf_dir, ["entity", "channel", "q", "fy"]).where(F.col("value_prior").isNotNull())
    stored = growth(F.col("value"), F.col("value_prior"))
    fresh = F.try_divide(F.col("value"), F.col("value_prior")) - 1
    return pairs.select(
        "entity", "channel", "fy", "q", stored.alias("stored"), F.round(fresh, 4).alias("recomputed"),
        (F.abs(stored - fresh) > 0.0001).alias("differs"),
    )


YTD = """
, ytd AS (SELECT entity, fy, q, CAST(SUM(CAST(value AS DECIMAL(38,4))) OVER (PARTITION BY entity, fy ORDER BY q) AS DOUBLE)
          AS value FROM panel)"""


def ytd_panel(spark, sf_dir, keys=("entity",), measures=("value",)):
    return series.year_to_date(panel(spark, sf_dir, [*keys, "fy", "q"], measures), keys, measures)


@query("ytd_cumulative", panel_sql("entity, fy, q") + YTD + " SELECT * FROM ytd")
def ytd_cumulative(spark, sf_dir):
    return ytd_panel(spark, sf_dir)


@query("monthly_run_rate", panel_sql("entity, fy, q") + YTD +
       " SELECT entity, fy, q, q * 3 AS months, value / (q * 3) AS run_rate FROM ytd")
def monthly_run_rate(spark, sf_dir):
    return ytd_panel(spark, sf_dir).select(
        "entity", "fy", "q", months_elapsed(F.col("q")).alias("months"),
        series.monthly_run_rate(F.col("value"), F.col("q")).alias("run_rate"),
    )


@query("annualized_point", panel_sql("entity, fy, q") + YTD +
       " SELECT entity, fy, q, value * (12 / (q * 3)) AS full_year FROM ytd")
def annualized_point(spark, sf_dir):
    return ytd_panel(spark, sf_dir).select(
        "entity", "fy", "q", series.annualized(F.col("value"), F.col("q")).alias("full_year")
    )


@query("accretion", paired_sql("entity, segment, q", "gross") + """
SELECT entity, segment, fy, q, gross AS revenue, gross_prior AS revenue_prior,
       CAST(round(CAST(gross AS DECIMAL(38,4)) - CAST(gross_prior AS DECIMAL(38,4)), 2) AS DOUBLE) AS accretion FROM pairs""")
def accretion_query(spark, sf_dir):
    pairs = paired_panel(spark, sf_dir, ["entity", "segment", "q", "fy"], ["gross"])
    money = lambda c: F.col(c).cast(series.MONEY)
    return pairs.select(
        "entity", "segment", "fy", "q", F.col("gross").alias("revenue"), F.col("gross_prior").alias("revenue_prior"),
        series.accretion(money("gross"), money("gross_prior")).cast("double").alias("accretion"),
    )


def history(spark, sf_dir, measures=("value", "gross", "claims")):
    """Long multi-year table: title, entity, fy_end, value."""
    years = panel(spark, sf_dir, ["entity", "fy"], measures)
    return years.unpivot(["entity", "fy"], list(measures), "title", "value").select(
        "title", "entity", (F.col("fy") + 1).alias("fy_end"), "value"
    )


HISTORY = panel_sql("entity, fy", "value, gross, claims") + """
, history AS (SELECT 'value' AS title, entity, fy + 1 AS fy_end, value FROM panel
   UNION ALL SELECT 'gross', entity, fy + 1, gross FROM panel UNION ALL SELECT 'claims', entity, fy + 1, claims FROM panel)"""


@query("cagr", HISTORY + """
, full_y AS (SELECT fy FROM (SELECT DISTINCT fy, q FROM facts) GROUP BY fy HAVING count(*) = 4)
, capped AS (SELECT * FROM history WHERE fy_end - 1 IN (SELECT fy FROM full_y))
, ends AS (SELECT title, min(fy_end) AS first_year, max(fy_end) AS last_year FROM capped GROUP BY title)
SELECT title, a.entity, first_year, last_year, a.value AS first_value, b.value AS last_value,
       round(pow(b.value / a.value, 1.0 / (last_year - first_year)) - 1, 8) AS cagr
FROM ends JOIN capped a USING (title) JOIN capped b USING (title)
WHERE a.fy_end = first_year AND b.fy_end = last_year AND a.entity = b.entity AND a.value > 0""")
def cagr_query(spark, sf_dir):
    # complete years only: the data's first and last ones may have fewer than four quarters
    full = history(spark, sf_dir).where((F.col("fy_end") - 1).isin(complete_years(spark, sf_dir)))
    return series.cagr(full, "title", "entity", "fy_end", "value")


@query("lane_scaling", HISTORY + """
SELECT title, entity, fy_end, value,
       0.5 + ((CASE WHEN hi = lo THEN 0.5 ELSE (value - lo) / (hi - lo) END) - 0.5) * 0.4 AS lane
FROM history JOIN (SELECT title, entity, min(value) AS lo, max(value) AS hi FROM history GROUP BY ALL) USING (title, entity)""")
def lane_scaling(spark, sf_dir):
    return series.lane_scale(history(spark, sf_dir), ["title", "entity"], "value")


@query("trend_with_point", panel_sql("entity, fy, q") + YTD + """
, full_years AS (SELECT entity, fy, value FROM ytd WHERE q = 4),
periods AS (SELECT DISTINCT fy, q FROM panel)
SELECT p.fy AS report_fy, p.q AS report_q, y.entity,
       'FY' || lpad(CAST((y.fy + 1) % 100 AS VARCHAR), 2, '0') AS label, y.value
FROM periods p JOIN full_years y ON y.fy + 1 <= CASE WHEN p.q = 4 THEN p.fy + 1 ELSE p.fy END
UNION ALL
SELECT fy, q, entity, 'Q' || q || ' FY' || lpad(CAST((fy + 1) % 100 AS VARCHAR), 2, '0'), value FROM ytd WHERE q < 4""")
def trend_with_point(spark, sf_dir):
    rows = in_reports(ytd_panel(spark, sf_dir), report_periods(spark, sf_dir))
    cols = ["report_fy", "report_q", "entity", "label", "value"]
    past, point = rows.where(F.col("q") == 4).select(*cols), rows.where(F.col("q") < 4).select(*cols)
    return series.trend_with_point(past, point, ["report_fy", "report_q", "entity"], "label")


@query("year_cap", HISTORY + """
SELECT p.fy AS report_fy, p.q AS report_q, title, entity, max(fy_end) AS last_year, count(*) AS years
FROM history JOIN (SELECT DISTINCT fy, q FROM facts) p ON fy_end <= CASE WHEN p.q = 4 THEN p.fy + 1 ELSE p.fy END
GROUP BY ALL""")
def year_cap(spark, sf_dir):
    reports = F.array(*[F.struct(F.lit(y).alias("report_fy"), F.lit(n).alias("report_q")) for y, n in report_periods(spark, sf_dir)])
    rows = history(spark, sf_dir).select("*", F.inline(reports))
    capped = series.cap_years(rows, series.cap_for(F.col("report_fy"), F.col("report_q")))
    return capped.groupBy("report_fy", "report_q", "title", "entity").agg(
        F.max("fy_end").alias("last_year"), F.count("*").alias("years"))


LEAD = paired_sql("entity, nationkey, q", "value, commission") + """
, d AS (SELECT *, value - value_prior AS change FROM pairs)
, lead AS (
  SELECT fy, q, max_by(entity, (value, -nationkey)) AS leader, max(value) AS leader_value,
         max_by(entity, (change, -nationkey)) FILTER (change IS NOT NULL) AS best, max(change) AS best_d,
         min_by(entity, (change, nationkey)) FILTER (change IS NOT NULL) AS worst, min(change) AS worst_d
  FROM d GROUP BY fy, q)
, leaders AS (
  SELECT fy, q, leader, leader_value, CASE WHEN best_d > 1e-9 THEN best END AS best_mover,
         CASE WHEN best_d > 1e-9 THEN best_d END AS best_change,
         CASE WHEN worst_d < -1e-9 AND worst <> best THEN worst END AS worst_mover,
         CASE WHEN worst_d < -1e-9 AND worst <> best THEN worst_d END AS worst_change FROM lead)"""


@query("leaders_movers", LEAD + " SELECT * FROM leaders")
def leaders_movers(spark, sf_dir):
    pairs = paired_panel(spark, sf_dir, ["entity", "nationkey", "q", "fy"])
    return series.leaders(pairs, ["fy", "q"], "entity", "nationkey", "value", "value_prior")


@query("top_insights", LEAD + """
SELECT fy, q, 1 AS line, 'leader' AS kind, leader AS entity, leader_value AS number FROM leaders
UNION ALL SELECT fy, q, 2, 'improved', best_mover, best_change FROM leaders WHERE best_mover IS NOT NULL
UNION ALL SELECT fy, q, 3, 'declined', worst_mover, worst_change FROM leaders WHERE worst_mover IS NOT NULL""")
def top_insights(spark, sf_dir):
    pairs = paired_panel(spark, sf_dir, ["entity", "nationkey", "q", "fy"])
    return series.insight_rows(
        pairs, ["fy", "q"], entity="entity", order="nationkey", cur="value", prior="value_prior")


@query("entity_rank", panel_sql("entity, fy, q") +
       " SELECT entity, fy, q, value, CAST(dense_rank() OVER (PARTITION BY fy, q ORDER BY value DESC) AS INTEGER) AS rank FROM panel")
def entity_rank(spark, sf_dir):
    return series.ranked(panel(spark, sf_dir, ["entity", "fy", "q"]), ["fy", "q"], "value")


@query("outlier_split", f"""WITH {FACTS}
, v AS (SELECT segment, fy, q, okey, CAST(SUM(claims) AS DOUBLE) AS value FROM facts GROUP BY ALL)
, med AS (SELECT segment, fy, q, median(DISTINCT value) AS median, count(DISTINCT value) AS n FROM v WHERE value > 0 GROUP BY ALL)
SELECT segment, fy, q, median, max(value) FILTER (value <= median * 5) AS normal_max,
       max(value) FILTER (value > median * 5) AS outlier_max
FROM v JOIN med USING (segment, fy, q) WHERE value > 0 AND n >= 2 GROUP BY ALL
HAVING normal_max IS NOT NULL AND outlier_max IS NOT NULL""")
def outlier_split(spark, sf_dir):
    rows = with_entity(spark, sf_dir, order_rows(spark, sf_dir, ["claims"]), ["segment"])
    rows = rows.withColumn("value", F.col("claims").cast("double") / UNIT)
    return series.outlier_split(rows, ["segment", "fy", "q"], "value")


@query("fiscal_calendar", """
SELECT fy, q, count(*) AS orders, q * 3 AS months, fy || '-' || lpad(CAST((fy + 1) % 100 AS VARCHAR), 2, '0') AS short_label,
       fy || '-' || (fy + 1) AS long_label,
       strftime(last_day(make_date(CASE WHEN q = 4 THEN fy + 1 ELSE fy END, CASE WHEN q = 4 THEN 3 ELSE q * 3 + 3 END, 1)), '%Y-%m-%d') AS closes,
       strftime(last_day(make_date(CASE WHEN q = 4 THEN fy + 1 ELSE fy END, CASE WHEN q = 4 THEN 3 ELSE q * 3 + 3 END, 1)), '%d %b %Y') AS closes_text,
       f || '_Q' || q AS column_label, CASE WHEN q = 4 THEN f ELSE f || ' Q' || q END AS label,
       CASE WHEN q = 4 THEN '' ELSE 'Q' || q || ' ' END || 'FY' || lpad(CAST((fy + 1) % 100 AS VARCHAR), 2, '0') AS trend
FROM (SELECT *, 'FY' || lpad(CAST(fy % 100 AS VARCHAR), 2, '0') || '-' || lpad(CAST((fy + 1) % 100 AS VARCHAR), 2, '0') AS f
      FROM (SELECT CAST(year(o_orderdate - INTERVAL 3 MONTH) AS INTEGER) AS fy,
                   CAST(quarter(o_orderdate - INTERVAL 3 MONTH) AS INTEGER) AS q FROM orders)) GROUP BY ALL""")
def fiscal_calendar(spark, sf_dir):
    fy, q = F.col("fy"), F.col("q")
    dates = read_table(spark, sf_dir, "orders").select(
        fiscal_year("o_orderdate").alias("fy"), fiscal_quarter("o_orderdate").alias("q"))
    periods = dates.groupBy("fy", "q").agg(F.count("*").alias("orders"))
    return periods.select(
        "fy", "q", "orders", months_elapsed(q).alias("months"), fy_label(fy).alias("short_label"),
        fy_label_long(fy).alias("long_label"), closing_date(fy, q).cast("string").alias("closes"),
        period_ending_text(fy, q).alias("closes_text"), period_column(fy, q).alias("column_label"),
        period_label(fy, q).alias("label"), trend_label(fy, q).alias("trend"),
    )


@query("fy_options", """
SELECT d, x AS option, CAST(i AS INTEGER) AS place FROM (
  SELECT d, unnest([1, 0, -1, -2, -3]) AS off, unnest([0, 1, 2, 3, 4]) AS i FROM (
    SELECT DISTINCT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS d FROM orders)) ,
  LATERAL (SELECT CAST(year(CAST(d AS DATE) - INTERVAL 3 MONTH) AS INTEGER) + off AS y) t ,
  LATERAL (SELECT 'FY' || lpad(CAST(y % 100 AS VARCHAR), 2, '0') || '-' || lpad(CAST((y + 1) % 100 AS VARCHAR), 2, '0') AS x) u""")
def fy_options_query(spark, sf_dir):
    days = read_table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("day")).distinct()
    return days.select(
        F.col("day").cast("string").alias("d"), F.posexplode(fy_options(F.col("day"))).alias("place", "option")
    )


@query("indian_grouping", panel_sql("entity, segment, fy, q") + """
, t AS (SELECT *, CAST(CAST(round(value) AS BIGINT) AS VARCHAR) AS s FROM panel)
SELECT entity, segment, fy, q,
  CASE WHEN length(s) <= 3 THEN s ELSE
    ltrim(reverse(regexp_replace(substr(reverse(s), 4), '(..)', '\\1,', 'g')), ',') || ',' || right(s, 3) END AS grouped,
  CASE WHEN abs(value) < 10 THEN format('{:,.2f}', value) ELSE format('{:,}', CAST(round(value) AS BIGINT)) END AS adaptive
FROM t""")
def indian_grouping_query(spark, sf_dir):
    return panel(spark, sf_dir, ["entity", "segment", "fy", "q"]).select(
        "entity", "segment", "fy", "q", indian_grouping(F.col("value")).alias("grouped"),
        adaptive_text(F.col("value")).alias("adaptive"),
    )


@query("opening_closing_average", panel_sql("entity, fy, q", "policies") + """
, ends AS (SELECT a.entity, a.fy, a.q, b.policies AS opening, a.policies AS closing
           FROM panel a LEFT JOIN panel b ON a.entity = b.entity AND b.fy = a.fy - 1 AND b.q = 4)
SELECT *, coalesce((nullif(opening, 0) + nullif(closing, 0)) / 2, nullif(opening, 0), nullif(closing, 0)) AS average FROM ends""")
def opening_closing_average(spark, sf_dir):
    p = panel(spark, sf_dir, ["entity", "fy", "q"], ["policies"])
    # the opening count of a year is the closing one of the last quarter before it
    closing = p.select("entity", "fy", "q", F.col("policies").alias("closing"))
    opening = p.where(F.col("q") == 4).select("entity", (F.col("fy") + 1).alias("fy"), F.col("policies").alias("opening"))
    both = closing.join(opening, ["entity", "fy"], "left")
    return both.withColumn("average", series.opening_closing_average(F.col("opening"), F.col("closing")))



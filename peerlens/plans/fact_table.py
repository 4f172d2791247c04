"""The metric table: one row is one metric of one entity, for a period and the same one a year earlier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.series import exact_sum
from .panel import pair_periods, panel


def metric_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """slide, category, company, metric1, metric2, cur, prior per fiscal period, from one pass over the panel.

    Slide 7 holds the segments of an entity, slide 8 its total, slide 12 its channels.
    """
    base = panel(spark, sf_dir, ["entity", "segment", "channel", "fy", "q"])
    cols = [F.col(c) for c in ("entity", "fy", "q", "segment", "channel")]
    sets = [cols[:4], cols[:3], [*cols[:3], cols[4]]]
    sums = base.groupingSets(sets, *cols).agg(
        F.grouping("segment").alias("_s"), F.grouping("channel").alias("_c"), exact_sum(F.col("value")).alias("value")
    )
    rows = sums.select(
        F.when(F.col("_s") == 0, 7).when(F.col("_c") == 0, 12).otherwise(8).alias("slide"),
        F.when(F.col("_s") == 0, "Segments").when(F.col("_c") == 0, "Channels").otherwise("Revenue").alias("category"),
        F.col("entity").alias("company"),
        F.when(F.col("_s") == 0, "Market share").when(F.col("_c") == 0, "Channel share").otherwise("Revenue Growth")
        .alias("metric1"),
        F.coalesce("segment", "channel").alias("metric2"),
        "fy", "q", "value",
    )
    keys = ["slide", "category", "company", "metric1", "metric2", "q"]
    return pair_periods(rows, keys, ["value"]).withColumnsRenamed({"value": "cur", "value_prior": "prior"})


ROWS_SQL = """
, rows0 AS MATERIALIZED (
  SELECT 7 AS slide, 'Segments' AS category, entity AS company, 'Market share' AS metric1, segment AS metric2, fy, q,
         SUM(value) AS v FROM facts GROUP BY entity, segment, fy, q
  UNION ALL SELECT 8, 'Revenue', entity, 'Revenue Growth', NULL, fy, q, SUM(value) FROM facts GROUP BY entity, fy, q
  UNION ALL SELECT 12, 'Channels', entity, 'Channel share', channel, fy, q, SUM(value) FROM facts GROUP BY entity, channel, fy, q)
, mrows AS MATERIALIZED (
  SELECT a.slide, a.category, a.company, a.metric1, a.metric2, a.q, a.fy, CAST(a.v AS DOUBLE) AS cur, CAST(b.v AS DOUBLE) AS prior
  FROM rows0 a LEFT JOIN rows0 b ON a.slide = b.slide AND a.company = b.company AND a.metric1 = b.metric1
   AND a.metric2 IS NOT DISTINCT FROM b.metric2 AND a.q = b.q AND b.fy = a.fy - 1)"""

"""Fill, lookup, set and snapshot queries over the metric table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.periods import fiscal_quarter, fiscal_year, fy_text
from ..operators import fill
from ..sources import metric_table
from ..sources.tables import read_table
from .fact_table import ROWS_SQL, metric_rows
from .panel import paired_panel, panel, years
from .registry import FACTS, paired_sql, panel_sql, query

KEYS = ["slide", "company", "metric1", "metric2", "fy", "q"]
ROWS = f"WITH {FACTS} {ROWS_SQL}"
# the table to fill: a third of the entities lack this year, the channel rows lack last year
GAPS_SQL = ROWS + """
, gaps AS (SELECT slide, company, metric1, metric2, fy, q,
   CASE WHEN substr(company, -1) IN ('1', '4', '7') THEN NULL ELSE round(cur, 1) END AS cur,
   CASE WHEN slide = 12 THEN NULL ELSE round(prior, 1) END AS prior, CAST(NULL AS DOUBLE) AS growth FROM mrows)"""


def with_gaps(rows):
    last = F.substring(F.col("company"), -1, 1)
    return rows.select(
        *KEYS,
        F.when(~last.isin("1", "4", "7"), F.round("cur", 1)).alias("cur"),
        F.when(F.col("slide") != 12, F.round("prior", 1)).alias("prior"),
        F.lit(None).cast("double").alias("growth"),
    )


G = "round(({0} - {1}) / nullif({1}, 0), 4)"


@query("fill_exact", GAPS_SQL + f"""
, src AS (SELECT * FROM mrows WHERE company <> 'NATION_3')
SELECT g.slide, g.company, g.metric1, g.metric2, g.fy, g.q,
  CASE WHEN use THEN coalesce(round(scur, 4), cur) ELSE cur END AS cur,
  CASE WHEN use THEN coalesce(round(sprior, 4), prior) ELSE prior END AS prior,
  CASE WHEN use THEN {G.format('scur', 'sprior')} END AS growth
FROM (SELECT g.*, s.cur AS scur, s.prior AS sprior, s.company IS NOT NULL AND (g.cur IS NULL OR g.prior IS NULL) AS use
  FROM gaps g LEFT JOIN src s ON g.slide = s.slide AND g.company = s.company AND g.metric1 = s.metric1
   AND g.metric2 IS NOT DISTINCT FROM s.metric2 AND g.fy = s.fy AND g.q = s.q) g""")
def fill_exact(spark, sf_dir):
    rows = metric_rows(spark, sf_dir)
    return fill.fill_exact(with_gaps(rows), rows.where(F.col("company") != "NATION_3"), KEYS)


@query("fill_exact_repeated", GAPS_SQL + """
SELECT g.slide, g.company, g.metric1, g.metric2, g.fy, g.q,
  CASE WHEN g.cur IS NULL OR g.prior IS NULL THEN coalesce(round(s.cur, 4), g.cur) ELSE g.cur END AS cur
FROM gaps g JOIN mrows s ON g.slide = s.slide AND g.company = s.company AND g.metric1 = s.metric1
   AND g.metric2 IS NOT DISTINCT FROM s.metric2 AND g.fy = s.fy AND g.q = s.q""")
def fill_exact_repeated(spark, sf_dir):
    """A source with an older row for every key, labels padded and empty for none: the newer row counts, once."""
    rows = metric_rows(spark, sf_dir)
    label = F.concat(F.lit(" "), F.coalesce("metric2", F.lit("")), F.lit(" "))
    older = rows.withColumns({"cur": F.col("cur") + 1, "seq": F.lit(1), "metric2": label})
    newer = rows.withColumns({"seq": F.lit(2), "metric2": F.coalesce("metric2", F.lit(""))})
    return fill.fill_exact(with_gaps(rows), newer.unionByName(older), KEYS, order="seq").select(*KEYS, "cur")


@query("fill_unmatched", GAPS_SQL + """
SELECT slide, company, metric1, metric2, fy, q, cur, prior FROM gaps
WHERE company = 'NATION_3' AND (cur IS NULL OR prior IS NULL)""")
def fill_unmatched(spark, sf_dir):
    rows = metric_rows(spark, sf_dir)
    return fill.unmatched(with_gaps(rows), rows.where(F.col("company") != "NATION_3"), KEYS).drop("growth")


def wildcard_sources(rows):
    """Entity totals offered to any second label, segment figures to their own, in that order."""
    total = rows.where(F.col("slide") == 8).select(
        F.lit(12).alias("slide"), F.upper("company").alias("company"), F.lit(" channel  SHARE ").alias("metric1"),
        F.lit(None).cast("string").alias("metric2"), "fy", "q", F.lit(1).alias("ord"), "cur", F.lit(None).cast("double").alias("prior"))
    channels = rows.where(F.col("slide") == 12).select(
        "slide", "company", "metric1", F.lower("metric2").alias("metric2"), "fy", "q", F.lit(2).alias("ord"),
        F.lit(None).cast("double").alias("cur"), "prior")
    return total.unionByName(channels)


@query("fill_wildcard", GAPS_SQL + f"""
, tot AS (SELECT company, fy, q, cur AS tcur FROM mrows WHERE slide = 8)
, ch AS (SELECT company, metric2, fy, q, prior AS cprior FROM mrows WHERE slide = 12)
SELECT g.slide, g.company, g.metric1, g.metric2, g.fy, g.q,
  CASE WHEN g.slide = 12 THEN tcur ELSE g.cur END AS cur, CASE WHEN g.slide = 12 THEN cprior ELSE g.prior END AS prior,
  CAST(NULL AS DOUBLE) AS growth
FROM gaps g LEFT JOIN tot USING (company, fy, q) LEFT JOIN ch ON ch.company = g.company AND ch.fy = g.fy AND ch.q = g.q AND ch.metric2 = g.metric2""")
def fill_wildcard(spark, sf_dir):
    rows = metric_rows(spark, sf_dir)
    return fill.fill_wildcard(with_gaps(rows), wildcard_sources(rows), ["fy", "q"])


@query("fill_rule_idempotent", ROWS + " SELECT slide, count(*) AS rows, CAST(0 AS BIGINT) AS changed FROM mrows GROUP BY slide")
def fill_rule_idempotent(spark, sf_dir):
    rows = metric_rows(spark, sf_dir)
    once = fill.fill_exact(with_gaps(rows), rows, KEYS)
    twice = fill.fill_exact(
        once.withColumnsRenamed({"cur": "c1", "prior": "p1"}).withColumns({"cur": F.col("c1"), "prior": F.col("p1")}), rows, KEYS)
    changed = ~F.col("cur").eqNullSafe(F.col("c1")) | ~F.col("prior").eqNullSafe(F.col("p1"))
    return twice.groupBy("slide").agg(F.count("*").alias("rows"), F.count_if(changed).alias("changed"))


@query("prior_backfill", GAPS_SQL + f"""
SELECT g.slide, g.company, g.metric1, g.metric2, g.fy, g.q, g.cur,
  CASE WHEN listed THEN coalesce(g.prior, h) ELSE g.prior END AS prior,
  CASE WHEN listed AND g.prior IS NULL AND h IS NOT NULL THEN {G.format('g.cur', 'h')} END AS growth
FROM (SELECT g.*, a.cur AS h, g.slide = 12 AND g.metric2 <> '5-LOW' AS listed FROM gaps g LEFT JOIN mrows a ON a.slide = g.slide AND a.company = g.company
      AND a.metric1 = g.metric1 AND a.metric2 IS NOT DISTINCT FROM g.metric2 AND a.q = g.q AND a.fy = g.fy - 1) g""")
def prior_backfill(spark, sf_dir):
    rows = metric_rows(spark, sf_dir)
    listed = spark.createDataFrame(
        [(12, "Channel share", c) for c in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED")] + [(38, "Employees", None)],
        "slide int, metric1 string, metric2 string")
    archive = rows.withColumn("row_no", F.lit(1))
    return fill.backfill_prior(with_gaps(rows), archive, listed)


@query("source_preference", paired_sql("entity, q", "claims_settled, claims_reported") + """
SELECT entity, fy, q, coalesce(nullif(claims_settled, 0), nullif(claims_reported, 0), claims_settled, claims_reported) AS cur,
  coalesce(nullif(claims_reported_prior, 0), nullif(claims_settled_prior, 0), claims_reported_prior, claims_settled_prior) AS prior
FROM pairs""")
def source_preference(spark, sf_dir):
    p = paired_panel(spark, sf_dir, ["entity", "q", "fy"], ["claims_settled", "claims_reported"])
    return p.select(
        "entity", "fy", "q", fill.prefer(F.col("claims_settled"), F.col("claims_reported")).alias("cur"),
        fill.prefer(F.col("claims_reported_prior"), F.col("claims_settled_prior")).alias("prior"))


@query("opening_balance", panel_sql("entity, fy, q", "policies") + """
SELECT a.entity, a.fy, a.q, a.policies AS closing, b.policies AS opening FROM panel a
LEFT JOIN panel b ON a.entity = b.entity AND b.fy = a.fy - 1 AND b.q = 4""")
def opening_balance(spark, sf_dir):
    p = panel(spark, sf_dir, ["entity", "fy", "q"], ["policies"])
    year_end = p.where(F.col("q") == 4).select("entity", (F.col("fy") + 1).alias("fy"), F.col("policies").alias("opening"))
    return p.withColumnRenamed("policies", "closing").join(year_end, ["entity", "fy"], "left")


@query("bucket_shim", ROWS + """
, b AS (SELECT company, metric2 AS bucket, fy, q, CASE WHEN metric2 = '1-URGENT' AND company IN ('NATION_2', 'NATION_9') THEN NULL ELSE cur END AS cur
        FROM mrows WHERE slide = 12)
, h AS (SELECT company, fy, q, bool_or(bucket = '1-URGENT' AND cur IS NOT NULL) AS a, bool_or(bucket = '2-HIGH' AND cur IS NOT NULL) AS c FROM b GROUP BY ALL)
SELECT company, CASE WHEN NOT a AND c THEN CASE bucket WHEN '1-URGENT' THEN '2-HIGH' WHEN '2-HIGH' THEN '1-URGENT' ELSE bucket END ELSE bucket END AS bucket,
  fy, q, cur FROM b JOIN h USING (company, fy, q)""")
def bucket_shim(spark, sf_dir):
    rows = metric_rows(spark, sf_dir).where(F.col("slide") == 12)
    lost = (F.col("metric2") == "1-URGENT") & F.col("company").isin("NATION_2", "NATION_9")
    b = rows.select("company", F.col("metric2").alias("bucket"), "fy", "q", F.when(~lost, F.col("cur")).alias("cur"))
    return fill.shift_bucket(b, ["company", "fy", "q"], "bucket", "cur", "1-URGENT", "2-HIGH")


@query("best_ranked", """
WITH c AS (SELECT regexp_extract(url, '^https?://([^/]*)', 1) AS host, url, length(url) * 1000000 + page_id AS rank, html FROM pages)
SELECT host, min_by(url, rank) AS url, min(rank) AS rank FROM c WHERE html LIKE '%<article>%' AND url LIKE 'https:%' GROUP BY host""")
def best_ranked(spark, sf_dir):
    pages = read_table(spark, sf_dir, "pages")
    c = pages.select(
        F.regexp_extract("url", "^https?://([^/]*)", 1).alias("host"), "url",
        (F.length("url") * 1000000 + F.col("page_id")).alias("rank"), F.col("html").contains("<article>").alias("ok"))
    return fill.best_ranked(c, ["host"], "url", "rank", F.col("ok") & F.col("url").startswith("https:"))


FORM_SPECS = [("premium_urgent", ["NL-36"], "money"), ("premium_high", ["NL-36", "NL-4"], "money"),
              ("premium_absent", ["NL-31"], "percent"), ("premium_low", ["NL-4"], "count")]


@query("form_regroup", ROWS + """
, specs(key, form, kind) AS (VALUES ('premium_urgent', 'NL-36', 'money'), ('premium_high', 'NL-36', 'money'), ('premium_high', 'NL-4', 'money'),
   ('premium_absent', 'NL-31', 'percent'), ('premium_low', 'NL-4', 'count'))
, r AS (SELECT 'premium_' || lower(split_part(metric2, '-', 2)) AS key, company, fy, q, true AS found, cur, prior FROM mrows WHERE slide = 12)
, holders AS (SELECT DISTINCT company, fy, q FROM r)
SELECT h.company, h.fy, h.q, form, s.key, kind, coalesce(found, false) AS found, cur, prior
FROM holders h CROSS JOIN specs s LEFT JOIN r ON s.key = r.key AND r.company = h.company AND r.fy = h.fy AND r.q = h.q""")
def form_regroup(spark, sf_dir):
    specs = spark.createDataFrame(FORM_SPECS, "key string, forms array<string>, kind string")
    rows = metric_rows(spark, sf_dir).where(F.col("slide") == 12)
    results = rows.select(
        F.concat(F.lit("premium_"), F.lower(F.split_part("metric2", F.lit("-"), F.lit(2)))).alias("key"), "company", "fy", "q",
        F.lit(True).alias("found"), "cur", "prior")
    return fill.regroup_by_form(specs, results, ["company", "fy", "q"])


# ---- sets ------------------------------------------------------------------------------

@query("expected_minus_found", f"""WITH {FACTS}
, found AS (SELECT DISTINCT suppkey, fy, q FROM facts)
SELECT s_suppkey AS suppkey, CAST(y AS INTEGER) AS fy, CAST(q AS INTEGER) AS q FROM supplier, (SELECT unnest(range(CAST(lo AS BIGINT), CAST(hi AS BIGINT) + 1)) AS y FROM (SELECT min(fy) AS lo, max(fy) AS hi FROM facts)) t, range(1, 5) u(q)
WHERE NOT EXISTS (SELECT 1 FROM found f WHERE f.suppkey = s_suppkey AND f.fy = y AND f.q = u.q)""")
def expected_minus_found(spark, sf_dir):
    first, last = years(spark, sf_dir)
    expected = read_table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("suppkey"), F.explode(F.sequence(F.lit(first), F.lit(last))).alias("fy")
    ).withColumn("q", F.explode(F.sequence(F.lit(1), F.lit(4))))
    orders = read_table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("okey"), fiscal_year("o_orderdate").alias("fy"), fiscal_quarter("o_orderdate").alias("q"))
    lines = read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("okey"), F.col("l_suppkey").alias("suppkey"))
    return fill.expected_minus_found(expected, lines.join(orders, "okey"), ["suppkey", "fy", "q"])


@query("registry_audit", ROWS + """
, t(slide, metric1, metric2) AS (VALUES (7, 'Market share', 'BUILDING'), (7, 'market  SHARE', 'Marine'), (8, 'Revenue growth', NULL),
   (12, 'Channel share', NULL), (12, 'Channel share', '1 - urgent'), (31, 'GWP', NULL), (12, 'Channel share', '6-NONE'))
SELECT * FROM t WHERE (slide, metric2) IN ((7, 'Marine'), (12, '6-NONE')) OR slide = 31""")
def registry_audit(spark, sf_dir):
    targets = spark.createDataFrame(
        [(7, "Market share", "BUILDING"), (7, "market  SHARE", "Marine"), (8, "Revenue growth", None), (12, "Channel share", None),
         (12, "Channel share", "1 - urgent"), (31, "GWP", None), (12, "Channel share", "6-NONE")],
        "slide int, metric1 string, metric2 string")
    return fill.targets_without_rows(targets, metric_rows(spark, sf_dir))


@query("registry_vs_keys", """
SELECT k AS key, 'left' AS only_in FROM (SELECT DISTINCT c_mktsegment AS k FROM customer) WHERE k NOT IN ('BUILDING', 'AVIATION', 'FURNITURE')
UNION ALL SELECT 'AVIATION', 'right'""")
def registry_vs_keys(spark, sf_dir):
    stored = read_table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("key")).distinct()
    registered = spark.createDataFrame([("BUILDING",), ("AVIATION",), ("FURNITURE",)], "key string")
    return fill.both_differences(stored, registered, "key")


@query("availability_intersection", """
SELECT n_nationkey AS nationkey FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal < 0)
INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 0""")
def availability_intersection(spark, sf_dir):
    registered = read_table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nationkey"))
    owing = read_table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_nationkey").alias("nationkey"))
    holding = read_table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_nationkey").alias("nationkey"))
    return registered.join(owing, "nationkey", "left_semi").intersect(holding)


@query("direct_and_derived", paired_sql("entity, q", "gross, accepted") + """
SELECT entity, fy, q, 'direct' AS origin, gross AS cur, gross_prior AS prior FROM pairs
UNION ALL SELECT entity, fy, q, 'derived', gross + accepted, gross_prior + accepted_prior FROM pairs""")
def direct_and_derived(spark, sf_dir):
    p = paired_panel(spark, sf_dir, ["entity", "q", "fy"], ["gross", "accepted"])
    direct = p.select("entity", "fy", "q", F.lit("direct").alias("origin"), F.col("gross").alias("cur"), F.col("gross_prior").alias("prior"))
    derived = p.select("entity", "fy", "q", F.lit("derived").alias("origin"), (F.col("gross") + F.col("accepted")).alias("cur"),
                       (F.col("gross_prior") + F.col("accepted_prior")).alias("prior"))
    return direct.unionByName(derived)


# ---- snapshots -------------------------------------------------------------------------

@query("latest_snapshot", """
WITH f AS (SELECT *, 'out/metrics_FY' || lpad(CAST(fy % 100 AS VARCHAR), 2, '0') || '-' || lpad(CAST((fy + 1) % 100 AS VARCHAR), 2, '0') || '_Q' || q
   || '_' || strftime(ts, '%Y%m%d_%H%M%S') || '.parquet' AS path
  FROM (SELECT CAST(year(o_orderdate - INTERVAL 3 MONTH) AS INTEGER) + 25 AS fy, CAST(quarter(o_orderdate - INTERVAL 3 MONTH) AS INTEGER) AS q,
        o_orderdate + to_hours(o_orderkey % 24) AS ts FROM orders))
SELECT fy, q AS quarter, max(path) AS path, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS run_ts FROM f GROUP BY ALL""")
def latest_snapshot(spark, sf_dir):
    ts = F.col("o_orderdate") + F.make_dt_interval(F.lit(0), (F.col("o_orderkey") % 24).cast("int"))
    files = read_table(spark, sf_dir, "orders").select(
        # moved on by 25 years: two-digit years belong to this century
        F.concat(F.lit("out/metrics_"), fy_text(fiscal_year("o_orderdate") + 25), F.lit("_Q"), fiscal_quarter("o_orderdate").cast("string"),
                 F.lit("_"), F.date_format(ts, "yyyyMMdd_HHmmss"), F.lit(".parquet")).alias("path"))
    dated = metric_table.with_period(files).where(F.col("fy").isNotNull())
    return metric_table.newest(dated, ["fy", "quarter"]).withColumn("run_ts", F.date_format("run_ts", "yyyy-MM-dd HH:mm:ss"))


@query("cleared_template", ROWS + " SELECT slide, company, metric1, metric2, fy, q, CAST(NULL AS DOUBLE) AS cur, CAST(NULL AS DOUBLE) AS prior FROM mrows")
def cleared_template(spark, sf_dir):
    rows = metric_rows(spark, sf_dir).withColumn("growth", F.lit(None).cast("double"))
    return metric_table.clear_values(rows).select(*KEYS, "cur", "prior")

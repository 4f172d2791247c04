"""Quality, document-gate, change-detection and streaming queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import fixed_values as fixed
from ..functions import text as txt
from ..functions import urls
from ..operators import documents as docs
from ..operators import quality, rollup, series
from ..session import shared_dir
from ..sources import metric_table
from ..sources.tables import read_table
from ..streaming import jobs
from .fact_table import ROWS_SQL, metric_rows
from .panel import panel, years
from .registry import FACTS, panel_sql, query

ROWS = f"WITH {FACTS} {ROWS_SQL}"
D = "CAST(SUM(CAST({0} AS DECIMAL(38,4))) AS DOUBLE)"
MIX = panel_sql("entity, channel, fy, q") + f"""
, t AS (SELECT entity, fy, q, {D.format('value')} AS t FROM panel GROUP BY ALL)
, mix AS (SELECT entity, channel, fy, q, CASE WHEN channel = '1-URGENT' AND entity = 'NATION_5' THEN 0.5 ELSE 1 END * round(value / nullif(t, 0), 4) AS share
   FROM panel JOIN t USING (entity, fy, q))"""


def faulty_mix(spark, sf_dir):
    """Channel shares, one of them halved for one entity."""
    mix = rollup.mix_share(panel(spark, sf_dir, ["entity", "channel", "fy", "q"]), ["entity", "fy", "q"], "value")
    wrong = (F.col("channel") == "1-URGENT") & (F.col("entity") == "NATION_5")
    return mix.withColumn("share", F.when(wrong, 0.5).otherwise(1.0) * F.col("share"))


@query("mix_invariant", MIX + """
, s AS (SELECT entity, fy, q, CAST(SUM(CAST(share AS DECIMAL(18,6))) AS DOUBLE) AS total, count(*) AS parts FROM mix GROUP BY ALL)
SELECT entity, fy, q, round(total, 6) AS total, parts FROM s WHERE parts < 5 OR abs(total - 1) > 0.005""")
def mix_invariant(spark, sf_dir):
    return quality.mix_failures(faulty_mix(spark, sf_dir), ["entity", "fy", "q"], "share", 5)


@query("mix_footnote", MIX + """
, s AS (SELECT entity, fy, q, CAST(SUM(CAST(share AS DECIMAL(18,6))) AS DOUBLE) AS total FROM mix GROUP BY ALL)
SELECT *, abs(total - 1) > 0.01 AS footnote FROM s""")
def mix_footnote(spark, sf_dir):
    return quality.mix_footnotes(faulty_mix(spark, sf_dir), ["entity", "fy", "q"], "share")


@query("parts_vs_total", panel_sql("entity, segment, fy, q") + f"""
, t AS (SELECT entity, fy, q, {D.format('value')} * CASE WHEN entity = 'NATION_8' THEN 1.02 ELSE 1 END AS printed, {D.format('value')} AS summed FROM panel GROUP BY entity, fy, q)
SELECT * FROM t WHERE printed <> 0 AND abs(summed - printed) > 0.005 * printed""")
def parts_vs_total(spark, sf_dir):
    parts = panel(spark, sf_dir, ["entity", "segment", "fy", "q"])
    totals = parts.groupBy("entity", "fy", "q").agg(series.exact_sum(F.col("value")).alias("value"))
    totals = totals.withColumn("value", F.col("value") * F.when(F.col("entity") == "NATION_8", 1.02).otherwise(1.0))
    return quality.parts_against_total(parts, totals, ["entity", "fy", "q"], "value")


@query("coverage", ROWS + """
SELECT n_name AS company, slide, CAST(y AS INTEGER) AS fy FROM nation, (VALUES (7), (8), (12), (16)) s(slide), (SELECT unnest(range(CAST(lo + 1 AS BIGINT), CAST(hi AS BIGINT) + 1)) AS y FROM (SELECT min(fy) AS lo, max(fy) AS hi FROM facts)) t
WHERE NOT EXISTS (SELECT 1 FROM mrows m WHERE m.company = n_name AND m.slide = s.slide AND m.fy = y AND prior IS NOT NULL)""")
def coverage(spark, sf_dir):
    first, last = years(spark, sf_dir)  # the first year has none before it
    expected = read_table(spark, sf_dir, "nation").select(
        F.col("n_name").alias("company"), F.explode(F.array(*[F.lit(s) for s in (7, 8, 12, 16)])).alias("slide")
    ).withColumn("fy", F.explode(F.sequence(F.lit(first + 1), F.lit(last))))
    return quality.missing_coverage(expected, metric_rows(spark, sf_dir), ["company", "slide", "fy"], "prior")


@query("sparse_slides", ROWS + """
SELECT slide, fy, q, count(DISTINCT company) FILTER (prior IS NOT NULL) AS entities FROM mrows GROUP BY ALL HAVING entities < 2""")
def sparse_slides(spark, sf_dir):
    return quality.sparse_slides(metric_rows(spark, sf_dir), ["slide", "fy", "q"], "company", "prior")


CLAIMED = """
, e AS (SELECT *, CASE WHEN slide = 7 THEN metric2 <> 'BUILDING' ELSE prior IS NOT NULL END AS found,
   CASE WHEN slide = 7 AND metric2 = 'FURNITURE' THEN NULL ELSE cur END AS c FROM mrows)
SELECT slide, company, metric1, metric2, fy, q, found, c AS cur, prior, (found AND c IS NOT NULL) OR (NOT found AND c IS NULL AND prior IS NULL) AS valid FROM e"""


def claimed_values(spark, sf_dir):
    rows = metric_rows(spark, sf_dir)
    found = F.when(F.col("slide") == 7, F.col("metric2") != "BUILDING").otherwise(F.col("prior").isNotNull())
    lost = (F.col("slide") == 7) & (F.col("metric2") == "FURNITURE")
    return rows.withColumn("found", found).withColumn("cur", F.when(~F.coalesce(lost, F.lit(False)), F.col("cur")))


@query("contract_quarantine", ROWS + CLAIMED)
def contract_quarantine(spark, sf_dir):
    cols = ["slide", "company", "metric1", "metric2", "fy", "q", "found", "cur", "prior"]
    valid, bad = quality.split_contract(claimed_values(spark, sf_dir))
    return valid.select(*cols, F.lit(True).alias("valid")).unionByName(bad.select(*cols, F.lit(False).alias("valid")))


@query("plausibility_review", ROWS + """
, r AS (SELECT slide, company, metric2, fy, q, cur, prior, (cur - prior) / nullif(prior, 0) AS rate, CASE slide WHEN 8 THEN 'total' ELSE 'part' END AS kind FROM mrows)
SELECT kind, slide, company, metric2, fy, q, rate, CAST(CASE kind WHEN 'total' THEN -0.5 ELSE -0.75 END AS DOUBLE) AS low, CAST(CASE kind WHEN 'total' THEN 0.5 ELSE 3.0 END AS DOUBLE) AS high FROM r
WHERE rate NOT BETWEEN CASE kind WHEN 'total' THEN -0.5 ELSE -0.75 END AND CASE kind WHEN 'total' THEN 0.5 ELSE 3.0 END""")
def plausibility_review(spark, sf_dir):
    bands = spark.createDataFrame([("total", -0.5, 0.5), ("part", -0.75, 3.0)], "kind string, low double, high double")
    rows = metric_rows(spark, sf_dir).select(
        F.when(F.col("slide") == 8, "total").otherwise("part").alias("kind"), "slide", "company", "metric2", "fy", "q",
        F.try_divide(F.col("cur") - F.col("prior"), F.col("prior")).alias("rate"))
    return quality.outside_band(rows, bands, "kind", "rate")


@query("provenance")
def provenance(spark, sf_dir):
    rows = metric_rows(spark, sf_dir)
    none = lambda t: F.lit(None).cast(t)
    values = rows.select(
        "company", "fy", "q", F.concat_ws("_", F.lit("value"), "slide", txt.fold_label(F.col("metric2"))).alias("key"),
        F.when(F.col("slide") == 8, "derived").otherwise("direct").alias("source"), F.lit("money").alias("kind"), "cur", "prior",
        F.col("cur").isNotNull().alias("found"), F.lit("NL-4").alias("source_form"), none("int").alias("page_number"),
        none("string").alias("evidence"), none("string").alias("notes"), "slide", "metric1", "metric2")
    return metric_table.provenance(values, ["company", "fy", "q"])


# ---- documents -------------------------------------------------------------------------

@query("untraceable_numbers", panel_sql("entity, segment, channel, fy, q", "value, policies") + r"""
, v AS (SELECT value AS v FROM panel UNION ALL SELECT policies FROM panel)
, r AS (SELECT DISTINCT CASE WHEN contains(s, '.') THEN rtrim(rtrim(s, '0'), '.') ELSE s END AS token FROM (
   SELECT CAST(CASE d WHEN 0 THEN CAST(CAST(round(v * k, 0) AS DECIMAL(38,0)) AS VARCHAR) WHEN 1 THEN CAST(CAST(round(v * k, 1) AS DECIMAL(38,1)) AS VARCHAR)
     WHEN 2 THEN CAST(CAST(round(v * k, 2) AS DECIMAL(38,2)) AS VARCHAR) WHEN 3 THEN CAST(CAST(round(v * k, 3) AS DECIMAL(38,3)) AS VARCHAR)
     ELSE CAST(CAST(round(v * k, 4) AS DECIMAL(38,4)) AS VARCHAR) END AS VARCHAR) AS s FROM v, (VALUES (1), (100)) x(k), range(0, 5) y(d)))
, t AS (SELECT doc_id, unnest(regexp_extract_all(text, '-?\d[\d.,]*')) AS raw FROM documents)
, p AS (SELECT doc_id, regexp_replace(regexp_replace(raw, '[-,]', '', 'g'), '\.+$', '') AS b FROM t)
, n AS (SELECT DISTINCT doc_id, CASE WHEN regexp_matches(b, '^\d+\.\d+$') THEN regexp_replace(regexp_replace(b, '0+$', ''), '\.$', '') ELSE b END AS token FROM p)
SELECT doc_id, token FROM n WHERE length(regexp_replace(token, '[-.]', '', 'g')) >= 2 AND token NOT IN (SELECT token FROM r)""")
def untraceable_numbers(spark, sf_dir):
    p = panel(spark, sf_dir, ["entity", "segment", "channel", "fy", "q"], ["value", "policies"])
    values = p.select(F.explode(F.array("value", "policies")).alias("value"))
    return quality.untraceable(read_table(spark, sf_dir, "documents"), "doc_id", "text", values, "value")


@query("page_numbers", r"""
WITH v AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>', ' ', 'g'),
   '(?is)<style\b.*?</style\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g') AS text FROM pages)
, p AS (SELECT page_id, regexp_replace(regexp_replace(unnest(regexp_extract_all(text, '-?\d[\d.,]*')), '[-,]', '', 'g'), '\.+$', '') AS b FROM v)
SELECT DISTINCT page_id, CASE WHEN regexp_matches(b, '^\d+\.\d+$') THEN regexp_replace(regexp_replace(b, '0+$', ''), '\.$', '') ELSE b END AS token FROM p""")
def page_numbers(spark, sf_dir):
    return read_table(spark, sf_dir, "pages").select(
        "page_id", F.explode(txt.stated_numbers(txt.visible_text(F.col("html")))).alias("token"))


@query("chart_numbers", """
WITH e AS (SELECT user_id, ts, value, event_id FROM events)
SELECT event_id, unnest(CASE WHEN CAST(value AS VARCHAR) = CAST(event_id AS VARCHAR) THEN [CAST(value AS VARCHAR)] ELSE [CAST(value AS VARCHAR), CAST(event_id AS VARCHAR)] END) AS token FROM e""")
def chart_numbers(spark, sf_dir):
    script = F.concat(
        F.lit("new Chart({type:'bar', labels: ['Q1', '2024'], datasets: [{data : ["), F.col("value").cast("string"), F.lit(", "),
        F.col("event_id").cast("string"), F.lit("], width: 77}]})"))
    return read_table(spark, sf_dir, "events").select("event_id", F.explode(txt.chart_numbers(script)).alias("token"))


TAGS = list(fixed.FORM_PATTERNS)
HEADINGS = ["FORM NL-1-B-RA", "FORM  NL-2-B-PL", "FORM NL-3-B-BS", "FORM NL-4 PREMIUM", "FORM NL-5", "FORM NL-6", "FORM NL-7", "FORM NL-10", "FORM NL-12A",
            "FORM NL-20", "NL-29 DETAILS REGARDING DEBT", "FORM NL-31", "FORM NL-33", "FORM NL-34", "FORM NL-36", "FORM NL-37", "FORM NL-39", "FORM NL-41"]
TAG_SQL = "[" + ", ".join(f"'{t}'" for t in TAGS) + "]"


def headed_documents(spark, sf_dir):
    """Documents with the heading of one schedule above and an index line below."""
    heading = F.element_at(F.array(*[F.lit(h) for h in HEADINGS]), (F.col("doc_id") % len(HEADINGS) + 1).cast("int"))
    return read_table(spark, sf_dir, "documents").withColumn(
        "text", F.concat(heading, F.lit("\n"), F.col("text"), F.lit("\n30 NL-29-DEBT SECURITIES 35")))


@query("form_detection", f"SELECT doc_id, {TAG_SQL}[CAST(doc_id % 18 AS INTEGER) + 1] AS form FROM documents")
def form_detection(spark, sf_dir):
    return headed_documents(spark, sf_dir).select("doc_id", F.explode(docs.forms_detected(F.col("text"))).alias("form"))


PHRASES = ["Results of the three months to 30th June, 2026", "the books were closed on June 30, 2026 and audited", "Position of 30/06/2026",
           "all amounts Jun-26", "The board met on 12 June, and looks back on the whole of 2026", "three months to 31 December 2025", "",
           "printed 30-6-26"]


def dated_documents(spark, sf_dir):
    phrase = F.element_at(F.array(*[F.lit(p) for p in PHRASES]), (F.col("doc_id") % len(PHRASES) + 1).cast("int"))
    return headed_documents(spark, sf_dir).withColumn("text", F.concat("text", F.lit("\n"), phrase, F.lit(" .")))


@query("period_stated", "SELECT doc_id, doc_id % 8 IN (0, 1, 2, 3, 7) AS stated FROM documents")
def period_stated(spark, sf_dir):
    return dated_documents(spark, sf_dir).select(
        "doc_id", docs.states_period(F.col("text"), F.lit("June"), F.lit(2026)).alias("stated"))


@query("document_verdict", """
WITH v AS (SELECT doc_id, CASE WHEN doc_id % 8 NOT IN (0, 1, 2, 3, 7) THEN 'period not stated' WHEN doc_id % 5 = 0 THEN NULL
  WHEN doc_id % 18 = 10 THEN 'no schedule heading' END AS reason FROM documents)
SELECT doc_id, reason IS NULL AS ok, reason FROM v""")
def document_verdict(spark, sf_dir):
    kind = F.when(F.col("doc_id") % 5 == 0, "xlsx").otherwise("pdf")
    v = docs.verdict(F.col("text"), kind, F.lit("June"), F.lit(2026))
    return dated_documents(spark, sf_dir).select("doc_id", v.alias("v")).select("doc_id", "v.ok", "v.reason")


@query("file_kind", """
SELECT doc_id, CASE WHEN strlen(text) + 4 > 4000 THEN 'too large' WHEN doc_id % 3 = 2 THEN 'wrong kind of file' END AS refused FROM documents""")
def file_kind(spark, sf_dir):
    head = F.when(F.col("doc_id") % 3 == 0, "%PDF").when(F.col("doc_id") % 3 == 1, "PK..").otherwise("<htm")
    kind = F.when(F.col("doc_id") % 3 == 1, "xlsx").otherwise("pdf")
    content = F.concat(head, F.col("text")).cast("binary")
    return read_table(spark, sf_dir, "documents").select("doc_id", docs.file_verdict(content, kind, 4000).alias("refused"))


def stored_fingerprints(d):
    """What an earlier run knew: every seventh document is new since, every tenth one was edited."""
    old = d.withColumn("text", F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return docs.with_fingerprint(old.where(F.col("doc_id") % 7 != 0), "text")


@query("changed_documents", "SELECT doc_id, sha256(text) AS sha256, CAST(strlen(text) AS INTEGER) AS size FROM documents WHERE doc_id % 7 = 0 OR doc_id % 10 = 0")
def changed_documents(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.changed(docs.with_fingerprint(d, "text"), stored_fingerprints(d), "doc_id").drop("text")


@query("recompute_needed", "SELECT doc_id FROM documents WHERE doc_id % 4 = 1 OR doc_id % 9 = 0")
def recompute_needed(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents").withColumn("prompt", F.lit("v1"))
    old = d.withColumn("prompt", F.when(F.col("doc_id") % 4 == 1, "v0").otherwise(F.col("prompt"))).where(F.col("doc_id") % 9 != 0)
    cache = old.withColumn("cache_key", txt.composite_fingerprint(F.col("text"), F.col("lang"), F.col("prompt")))
    return docs.needs_recompute(d, cache, "doc_id", ["text", "lang", "prompt"]).select("doc_id")


@query("lead_text", """
SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS lead FROM conversations
WHERE turn BETWEEN 0 AND 5 GROUP BY conv_id""")
def lead_text(spark, sf_dir):
    return docs.lead_text(read_table(spark, sf_dir, "conversations"), ["conv_id"], "turn", "text", first=0)


PATHS = ["/disclosures/2025/december/Q3_report_dec2025.pdf", "/static/report.pdf", "/files/2025-26/Q3/1250.pdf", "/x/2025/Dec.pdf"]
TEMPLATES = ["/disclosures/{year}/{month}/{quarter}_report_{mon}{year}.pdf", None, "/files/20{fy_short}/{quarter}/1250.pdf", "/x/{year}/{mon}.pdf"]


@query("url_template", "SELECT page_id, CASE WHEN page_id % 8 = 4 THEN NULL ELSE regexp_extract(url, '^(https?://[^/]*)', 1) || " +
       "CASE page_id % 4 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(TEMPLATES) if t) + " END || '?v=2025' END AS template FROM pages")
def url_template(spark, sf_dir):
    path = F.element_at(F.array(*[F.lit(p) for p in PATHS]), (F.col("page_id") % 4 + 1).cast("int"))
    query_part = F.when(F.col("page_id") % 8 == 4, "?sig=abc&v=2025").otherwise("?v=2025")
    url = F.concat(F.regexp_extract("url", "^(https?://[^/]*)", 1), path, query_part)
    return read_table(spark, sf_dir, "pages").select(
        "page_id", urls.templatize_url(url, F.lit("December"), F.lit(2025), F.lit("Q3")).alias("template"))


@query("url_candidates", """
WITH u AS (SELECT page_id, regexp_extract(url, '^(https?://[^/]*)', 1) AS h FROM pages)
SELECT page_id, CAST(i AS INTEGER) AS place, h || '/' || m || '/2026/' || q || '_' || a || '.pdf' AS url FROM u,
 (VALUES (0, 'June', 'Jun', 'Q1'), (1, 'june', 'jun', 'q1'), (2, 'JUNE', 'JUN', 'Q1')) c(i, m, a, q)""")
def url_candidates(spark, sf_dir):
    template = F.concat(F.regexp_extract("url", "^(https?://[^/]*)", 1), F.lit("/{month}/{year}/{quarter}_{mon}.pdf"))
    return read_table(spark, sf_dir, "pages").select(
        "page_id", F.posexplode(urls.render_url(template, F.lit("June"), F.lit(2026), F.lit("Q1"))).alias("place", "url"))


# ---- streaming -------------------------------------------------------------------------

def _run_dir(spark, name):
    return f"{shared_dir(spark).rstrip('/')}/peerlens/{name}-{uuid.uuid4().hex}"


@query("intake_stream", """
SELECT doc_id, sha256(text) AS sha256, CAST(strlen(text) AS INTEGER) AS size FROM (SELECT doc_id, CASE doc_id % 6
   WHEN 0 THEN 'FORM NL-4' WHEN 1 THEN 'FORM NL-7' ELSE 'Contents' END || chr(10) || text || chr(10) ||
   CASE WHEN doc_id % 4 = 0 THEN 'Quarter ended March 31, 2025' ELSE 'As at 30 June 2026' END AS text FROM documents)
WHERE doc_id % 6 < 2 AND doc_id % 4 <> 0""")
def intake_stream(spark, sf_dir):
    """Documents with a heading and a closing line pass the gate of a disclosure of June 2026; the others are kept apart."""
    folder = _run_dir(spark, "intake")
    gate = docs.verdict(F.col("text"), F.lit("pdf"), F.lit("June"), F.lit(2026))
    schema = read_table(spark, sf_dir, "documents").schema
    six, four = F.col("doc_id") % 6, F.col("doc_id") % 4
    heading = F.when(six == 0, "FORM NL-4").when(six == 1, "FORM NL-7").otherwise("Contents")
    closing = F.when(four == 0, "Quarter ended March 31, 2025").otherwise("As at 30 June 2026")
    # the second intake starts anew and finds nothing to add
    for attempt in ("first", "again"):
        stream = jobs.file_stream(spark, sf_dir, "documents.parquet", schema)
        stream = stream.withColumn("text", F.concat(heading, F.lit("\n"), "text", F.lit("\n"), closing))
        jobs.intake(stream, "doc_id", "text", gate, f"{folder}/store", f"{folder}/{attempt}", f"{folder}/refused")
    return jobs.newest_intake(spark, f"{folder}/store", "doc_id").select("doc_id", "sha256", "size")


@query("progress_fold", """
SELECT user_id, max(value) AS progress, max_by(event_type, (ts, event_id)) AS status FROM events GROUP BY user_id""")
def progress_fold(spark, sf_dir):
    folder = _run_dir(spark, "progress")
    stream = jobs.file_stream(spark, sf_dir, "events.parquet", read_table(spark, sf_dir, "events").schema)
    jobs.progress_fold(stream, "user_id", "value", "event_type", "ts", "event_id", f"{folder}/store", f"{folder}/checkpoint")
    return jobs.current_progress(spark, f"{folder}/store", "user_id")

"""Literal cases of the scalar functions."""

import math

import pytest
from pyspark.sql import functions as F

from peerlens.functions import numbers as num
from peerlens.functions import periods as per
from peerlens.functions import text as txt
from peerlens.functions import urls
from peerlens.operators import documents as docs


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def each(spark, values, kind, fn):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in rows.select("i", fn(F.col("v")).alias("x")).orderBy("i").collect()]


def test_rounding(spark):
    got = each(spark, [0.5, 1.5, 2.5, -2.5, 7.0], "double", lambda c: F.round(c, 0))
    assert got == [1, 2, 3, -3, 7]
    assert each(spark, [0.125, 2.675], "double", lambda c: F.round(c, 2)) == [0.13, 2.68]
    assert math.isnan(one(spark, F.round(F.lit(float("nan")), 2)))


def test_fixed_text(spark):
    assert each(spark, [0.5, -0.04, 12.25, None], "double", lambda c: num.fixed_text(c, 1)) == ["0.5", "0.0", "12.3", None]
    assert one(spark, num.fixed_text(F.lit(0.5), 0)) == "1"
    assert one(spark, num.fixed_text(F.lit(1234567.5), 0, True)) == "1,234,568"


def test_indian_grouping(spark):
    got = each(spark, [307666.0, 999.0, 1000.0, -12345678.4, 0.0, None], "double", num.indian_grouping)
    assert got == ["3,07,666", "999", "1,000", "-1,23,45,678", "0", None]


def test_printed_number(spark):
    values = ["1,45,357", "(1,234)", "-", "", None, "1 ,54,542", "–", "n.a.", "NaN", "1e3", "(-)", "12.5"]
    assert each(spark, values, "string", num.printed_number) == [145357, -1234, 0, 0, 0, 154542, 0, None, None, 1000, 0, 12.5]


def test_cell_number(spark):
    values = ["4 ,93,346", "7,194 167", "-", "", None, "5.45%", "(1,234)", "(12) 3", "abc"]
    assert each(spark, values, "string", num.cell_number) == [493346, 7194, None, None, None, 5.45, -1234, -12, None]


def test_line_numbers(spark):
    assert one(spark, num.line_numbers(F.lit("Ratio 1.66 1.28 9 .13 1 7.65"))) == [1.66, 1.28, 9.13, 17.65]
    assert one(spark, num.line_numbers(F.lit(" NL-5 ( 310.06) 12 - 1 ,102.73"))) == [-310.06, 12, 0, 1102.73]
    assert one(spark, num.last_number(F.lit("settled 12 1 ,450"))) == 1450
    assert one(spark, num.last_filled_number(F.array(F.lit("a"), F.lit("12"), F.lit("-"), F.lit("")))) == 12


def test_growth_and_ratios(spark):
    f = F.lit
    assert one(spark, num.growth(f(5.0), f(-4.0))) == -2.25
    assert one(spark, num.growth(f(5.0), f(0.0))) is None
    assert one(spark, num.display_growth(f(5.0), f(-4.0))) is None
    assert one(spark, num.growth_label(f(0.126))) == "+13%"
    assert one(spark, num.growth_label(f(-0.126))) == "-13%"
    assert one(spark, num.ratio(f(1.0), f(3.0))) == 0.3333
    none = f(None).cast("double")
    assert one(spark, num.sum_available(none, f(2.0), none)) == 2
    assert one(spark, num.sum_available(none, none)) is None
    assert one(spark, num.base_plus(none, f(2.0))) is None
    assert one(spark, num.convert_units(f(500.0), f("money"))) == 5


@pytest.mark.parametrize("text", ["FY25-26", "fy25-26", "FY 25-26", "25-26", "2025-26", "2025-2026", "FY2025-2026", "FY25_26", "FY25/26", "FY26", "2026"])
def test_normalize_fy(spark, text):
    assert one(spark, per.normalize_fy(F.lit(text))) == 2025


@pytest.mark.parametrize("text", ["FY25-27", "FY26-26", "FY9", "", "banana", "FY25-24", None])
def test_invalid_fy(spark, text):
    assert one(spark, per.normalize_fy(F.lit(text).cast("string"))) is None


def test_calendar(spark):
    fy = F.lit(2025)
    ends = [one(spark, per.period_ending_text(fy, F.lit(q))) for q in (1, 2, 3, 4)]
    assert ends == ["30 Jun 2025", "30 Sep 2025", "31 Dec 2025", "31 Mar 2026"]
    assert [one(spark, per.closing_month(F.lit(q))) for q in (1, 4)] == ["June", "March"]
    assert one(spark, per.period_column(fy - 1, F.lit(3))) == "FY24-25_Q3"
    assert one(spark, per.period_label(fy, F.lit(4))) == "FY25-26"
    assert one(spark, per.trend_label(F.lit(2026), F.lit(1))) == "Q1 FY27"
    assert one(spark, per.fy_options(F.to_date(F.lit("2026-03-31")))) == ["FY26-27", "FY25-26", "FY24-25", "FY23-24", "FY22-23"]
    assert one(spark, per.year_fragments(fy, F.lit(4))) == ["2026", "-26"]


def test_states_year(spark):
    y = lambda t, n: one(spark, per.states_year(F.lit(t), F.lit(n)))
    assert y("December 31, 2025", 2025) and y("31-Dec-25", 2025) and not y("31-Dec-25", 2024)
    assert not y("1998", 1999)  # 99 inside another year is no year


def test_period_from_path(spark):
    p = one(spark, per.period_from_path(F.lit("s3a://x/metrics_FY25-26_Q3_20260131_101500.parquet")))
    assert (p.fy, p.quarter, str(p.run_ts)) == (2025, 3, "2026-01-31 10:15:00")
    assert one(spark, per.period_from_path(F.lit("metrics_UI.parquet"))).fy is None


def test_text(spark):
    assert one(spark, txt.fold_text(F.lit("  Corporate  Agents -  Banks "))) == "corporate agents-banks"
    assert one(spark, txt.fold_label(F.lit("Marine  Cargo "))) == "marinecargo"
    assert one(spark, txt.identifier(F.lit("(a) P.A. & co"))) == "a_P_A_co"
    assert one(spark, txt.visible_text(F.lit("<p>1<script>var x=9</script><b>2</b><!-- 7 -->"))).split() == ["1", "2"]
    assert sorted(one(spark, txt.stated_numbers(F.lit("1,234.50 and -12. or 1234.5 7")))) == ["12", "1234.5", "7"]
    chart = "labels:['2024'], data: [1.5, 22], data:[22,3] width: 9"
    assert one(spark, txt.chart_numbers(F.lit(chart))) == ["1.5", "22", "3"]
    a = one(spark, txt.composite_fingerprint(F.lit("ab"), F.lit("c")))
    assert a != one(spark, txt.composite_fingerprint(F.lit("a"), F.lit("bc")))


def test_url_round_trip(spark):
    url = "https://h.example/disclosures/2025/december/Q3_x_dec2025.pdf?v=2025"
    args = (F.lit("December"), F.lit(2025), F.lit("Q3"))
    t = one(spark, urls.templatize_url(F.lit(url), *args))
    assert t == "https://h.example/disclosures/{year}/{month}/{quarter}_x_{mon}{year}.pdf?v=2025"
    assert url in one(spark, urls.render_url(F.lit(t), *args)) or url.lower() in [u.lower() for u in one(spark, urls.render_url(F.lit(t), *args))]
    assert "https://h.example/disclosures/2026/june/q1_x_jun2026.pdf?v=2025" in one(
        spark, urls.render_url(F.lit(t), F.lit("June"), F.lit(2026), F.lit("Q1")))
    assert one(spark, urls.templatize_url(F.lit("https://h.example/a.pdf?sig=2025"), *args)) is None
    assert one(spark, urls.templatize_url(F.lit("https://h.example/doc/1250.pdf"), *args)) is None
    assert one(spark, urls.monthly_path("https://h.example/r", F.lit("June"), F.lit(2026))) == "https://h.example/r/Year_2026/segment_june_2026.xlsx"


@pytest.mark.parametrize("text,stated", [
    ("FOR THE PERIOD ENDED 30th JUNE , 2026", True), ("quarter ended June 30, 2026", True), ("as on 30/06/2026", True),
    ("Jun-26 figures", True), ("Information as on 31/03/2025. Signed 12 June in the year 2026 crore", False),
    ("quarter ended 31 December 2025", False), ("", False)])
def test_period_stated(spark, text, stated):
    assert one(spark, docs.states_period(F.lit(text), F.lit("June"), F.lit(2026))) is stated


def test_forms(spark):
    assert one(spark, docs.forms_detected(F.lit("x FORM NL-41"))) == ["NL-41"]
    assert one(spark, docs.forms_detected(F.lit("FORM NL-12A"))) == ["NL-12"]
    assert one(spark, docs.forms_detected(F.lit("index\n30 NL-29-DEBT SECURITIES"))) == []
    assert one(spark, docs.forms_detected(F.lit("head\n NL-29 DETAILS"))) == ["NL-29"]


def test_file_verdict(spark):
    v = lambda b, k, n=100: one(spark, docs.file_verdict(F.lit(b), F.lit(k), n))
    assert v(b"%PDF-1.7", "pdf") is None and v(b"PK\x03", "xlsx") is None
    assert v(b"<html>", "pdf") == "wrong kind of file" and v(b"%PDF" + b"x" * 200, "pdf") == "too large"


def test_figures_are_rejoined_piece_by_piece(spark):
    read = lambda t: one(spark, num.line_numbers(F.lit(t)))
    assert read("Premium (1 ,234.50 ) 3 45.10 - 12 345.10") == [-1234.5, 345.1, 0, 12, 345.1]
    assert read("1.5 12.30") == [1.5, 12.3]  # a digit after a point is no piece of its own
    assert read("( 5 7 .25 )") == [-57.25] and read("") == [] and read(None) is None

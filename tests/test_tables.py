"""Fills, workbooks, snapshots, registry and rollups on small literal tables."""

import json
import os

import pytest
from pyspark.sql import functions as F

from peerlens.operators import documents as docs
from peerlens.operators import fill, formulas, quality, report, rollup, series
from peerlens.sources import block_sheet, filings, history, metric_table, registry

ROW = "slide int, company string, metric1 string, metric2 string, fy int, q int, cur double, prior double, growth double"


def target(spark, rows):
    return spark.createDataFrame([(5, "A", "m", m2, 2025, 3, c, p, g) for m2, c, p, g in rows], ROW)


def test_fill_rule(spark):
    t = target(spark, [("x", 1.0, 2.0, None), ("y", 1.0, None, None), ("z", None, None, 0.5), ("u", None, 3.0, None)])
    keys = ["slide", "company", "metric1", "metric2", "fy", "q"]
    src = spark.createDataFrame(
        [(5, "A", "m", "x", 2025, 3, 9.0, 9.0), (5, "A", "m", "y", 2025, 3, 8.0, 4.0), (5, "A", "m", "z", 2025, 3, 7.00004, None)],
        "slide int, company string, metric1 string, metric2 string, fy int, q int, cur double, prior double")
    got = {r.metric2: (r.cur, r.prior, r.growth) for r in fill.fill_exact(t, src, keys).collect()}
    # a full row stays, a half-filled one is overwritten on both sides, growth only when it can be told
    assert got == {"x": (1, 2, None), "y": (8, 4, 1.0), "z": (7.0, None, 0.5), "u": (None, 3, None)}
    assert [r.metric2 for r in fill.unmatched(t, src, keys).collect()] == ["u"]
    forced = {r.metric2: r.cur for r in fill.fill_exact(t, src, keys, force=True).collect()}
    assert forced["x"] == 9


def test_wildcard_order(spark):
    t = target(spark, [("x", None, None, None), ("y", None, None, None)])
    src = "slide int, company string, metric1 string, metric2 string, fy int, q int, ord int, cur double, prior double"
    both = [(5, " a ", "M", None, 2025, 3, 1, 1.0, None), (5, "A", "m", "X", 2025, 3, 2, 5.0, 2.0)]
    got = {r.metric2: (r.cur, r.prior) for r in fill.fill_wildcard(t, spark.createDataFrame(both, src), ["fy", "q"]).collect()}
    assert got == {"x": (5, 2), "y": (1, None)}
    full = [(5, "A", "m", None, 2025, 3, 1, 1.0, 3.0), both[1]]
    got = {r.metric2: (r.cur, r.prior) for r in fill.fill_wildcard(t, spark.createDataFrame(full, src), ["fy", "q"]).collect()}
    assert got["x"] == (1, 3)  # full after the first source: the second one no longer counts


def test_backfill_keeps_own_value(spark):
    t = target(spark, [("x", 10.0, None, None), ("y", 10.0, 4.0, None)])
    archive = spark.createDataFrame([(5, "A", "m", m, 2024, 3, 8.0, None, None, n) for n, m in enumerate("xy")], ROW + ", row_no int")
    listed = spark.createDataFrame([(5, "M", None)], "slide int, metric1 string, metric2 string")
    got = {r.metric2: (r.prior, r.growth) for r in fill.backfill_prior(t, archive, listed).collect()}
    assert got == {"x": (8, 0.25), "y": (4, None)}


def sheet(spark, rows):
    return spark.createDataFrame([("s", i, r) for i, r in enumerate(rows)], "sheet string, r bigint, cells array<string>")


def test_block_sheet_pairs(spark):
    rows = [["Title", None, None], [None, "Fire", "Health "], ["General Insurers", None, None], ["A", "1", "2"], ["Previous Year", "3", "4"],
            ["B", "5", "6"], ["Sub Total", "6", "8"], ["Previous Year Sub Total", "7", "9"], ["% Growth", "1", "1"], ["Previous Year Stray", "1", "1"],
            ["% Market Share", "0.4", "0.6"], ["Previous Year Market Share", "0.5", "0.5"]]
    got = {(r.label, r.col): (r.cur, r.prev) for r in block_sheet.read_block_sheet(sheet(spark, rows), ["sheet"]).collect()}
    assert got[("A", "Fire")] == (1, 3) and got[("A", "Health ")] == (2, 4)
    assert got[("B", "Fire")] == (5, None)  # no pair of its own
    assert got[("Sub Total", "Health ")] == (8, 9)
    assert got[("Previous Year Stray", "Fire")] == (1, None)  # nothing above it takes it
    assert "Previous Year" not in {k[0] for k in got} and "% Growth" not in {k[0] for k in got}
    share = {r.col: (r.cur, r.prev) for r in block_sheet.read_market_share(sheet(spark, rows), ["sheet"]).collect()}
    assert share == {"Fire": (0.4, 0.5), "Health ": (0.6, 0.5)}


def test_history_blocks(spark):
    rows = [["GWP:", None, None], ["Particulars", "FY24", "FY25"], ["A", "1", "2"], ["b", "3", None], ["Total Health", "9", "9"], ["PBT", None, None],
            ["Particulars", "FY24", None], ["A", "7", "8"], [None, None, None], ["Particulars", "FY25", None], ["A", "5", None]]
    known = lambda c: F.when(F.lower(c).isin("a", "b"), F.upper(c))
    got = {(r.title, r.entity, r.fy_end): r.value for r in history.read_history(sheet(spark, rows), ["sheet"], known).collect()}
    assert got == {("GWP", "A", 24): 1, ("GWP", "A", 25): 2, ("GWP", "B", 24): 3, ("GWP", "B", 25): None, ("PBT", "A", 24): 7, ("Untitled", "A", 25): 5}


def test_append_year(spark):
    h = spark.createDataFrame([("g", "A", 2024, 1.0), ("g", "SAHI", 2024, 2.0), ("p", "A", 2024, 1.0)], "title string, entity string, fy_end int, value double")
    point = spark.createDataFrame([("g", "A", 5.0)], "title string, entity string, value double")
    required = spark.createDataFrame([("A",)], "entity string")
    out, skipped = history.append_year(h, point, required, 2025, 4)
    assert {(r.title, r.entity) for r in out.where("fy_end = 2025").collect()} == {("g", "A")}
    assert [(r.title, r.missing) for r in skipped.collect()] == [("p", 1)]
    with pytest.raises(ValueError):
        history.append_year(h, point, required, 2025, 3)


def test_snapshots(spark, tmp_path):
    df = target(spark, [("x", 1.0, 2.0, None)]).withColumn("category", F.lit("c"))
    path = str(tmp_path / "snap")
    for ts in ("20260101_000000", "20260202_000000"):
        metric_table.write_snapshot(df.withColumn("cur", F.lit(float(ts[:8]))), path, F.lit(ts))
    assert metric_table.read_rows(spark, path).count() == 2
    newest = metric_table.newest_rows(spark, path).collect()
    assert [(r.period, r.cur) for r in newest] == [("FY25-26_Q3", 20260202.0)]
    cleared = metric_table.clear_values(df).first()
    assert cleared.cur is None and cleared.metric2 == "x"
    assert "FY25-26_Q3" in metric_table.label_periods(df, "FY25-26_Q3", "FY24-25_Q3").columns
    labels = spark.createDataFrame([("a", "b"), ("c", "c"), (None, "d")], "old string, new string")
    assert metric_table.changed_labels(labels, "old", "new").count() == 2


def test_slides_must_be_numbers(spark, tmp_path):
    path = tmp_path / "rows.csv"
    path.write_text("slide,category,company,metric1,metric2,source_tab,source_link,cur,prior,growth\n5,c,A,m,,,,1.5,,\nnote,c,A,m,,,,,,\n")
    rows = metric_table.read_rows_csv(spark, str(path)).collect()
    assert [(r.slide, r.cur) for r in rows] == [(5, 1.5)]


def test_registry_and_files(spark, tmp_path):
    src = tmp_path / "links.json"
    src.write_text(json.dumps({"Sun Mutual & Allied": {"url": "https://h.example/a"}, "GIC": {"url": "u", "file_type": "xlsx"}}, indent=1))
    rows = {r.name: r for r in registry.read_sources(spark, str(src)).collect()}
    assert rows["Sun Mutual & Allied"].file_name == "Sun_Mutual_and_Allied.pdf"
    assert rows["Sun Mutual & Allied"].slug == "sun-mutual-and-allied" and rows["GIC"].file_name == "GIC.xlsx"
    folder = tmp_path / "files"
    folder.mkdir()
    (folder / "GIC.xlsx").write_bytes(b"PK")
    got = registry.availability(registry.read_sources(spark, str(src)), registry.listed_files(spark, str(folder)))
    assert {r.name: r.found for r in got.collect()} == {"GIC": True, "Sun Mutual & Allied": False}


def test_filing_documents(spark, tmp_path):
    doc = {"company": "A", "source_file": "a.pdf", "pdf_sha256": "x", "pdf_size": 1, "pages": [
        {"page_number": 1, "forms_detected": ["NL-4"], "tables": [[["a", None], ["b", "1"]]], "text": "t"}, {"page_number": 2, "forms_detected": [], "tables": [], "text": "u"}]}
    (tmp_path / "a.json").write_text(json.dumps(doc, indent=1))
    f = filings.read_filings(spark, str(tmp_path), multi_line=True)
    assert filings.page_rows(f, "company").count() == 2
    assert [(r.r, r.cells) for r in filings.table_rows(f, "company").orderBy("r").collect()] == [(0, ["a", None]), (1, ["b", "1"])]
    assert filings.cell_rows(filings.table_rows(f, "company"), "company").count() == 4


def test_provenance_files(spark, tmp_path):
    values = target(spark, [("x", 1.0, None, None), ("y", 2.0, None, None)])
    for c in ("key", "source", "kind", "source_form", "evidence", "notes"):
        values = values.withColumn(c, F.lit(c))
    values = values.withColumns({"found": F.lit(True), "page_number": F.lit(3)})
    metric_table.write_provenance(metric_table.provenance(values), str(tmp_path / "p"))
    back = spark.read.json(str(tmp_path / "p"))
    assert back.count() == 2 and back.first().entry.target_rows[0].slide == 5


def test_contract(spark):
    rows = [(True, 500.0, 400.0), (True, None, 400.0), (False, None, None), (False, 1.0, None), (None, None, None)]
    df = spark.createDataFrame(rows, "found boolean, cur double, prior double")
    valid, bad = quality.split_contract(df)
    assert valid.count() == 3 and bad.count() == 2


def test_median_and_outliers(spark):
    rows = [("a", float(v)) for v in (1, 2, 2, 2, 3, 100)] + [("b", float(v)) for v in (1, 2, 3)] + [("c", 5.0), ("d", -1.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    med = {r.g: r.median for r in series.distinct_median(df, ["g"], "v").collect()}
    assert med == {"a": 2.5, "b": 2, "c": 5}
    got = series.outlier_split(df, ["g"], "v").collect()
    assert [(r.g, r.normal_max, r.outlier_max) for r in got] == [("a", 3, 100)]


def test_leaders_ties_and_directions(spark):
    rows = [("A", 1, 5.0, 4.0), ("B", 2, 5.0, 7.0), ("C", 3, 1.0, None)]
    df = spark.createDataFrame(rows, "e string, o int, cur double, prior double").withColumn("g", F.lit(1))
    r = series.leaders(df, ["g"], "e", "o", "cur", "prior").first()
    assert (r.leader, r.best_mover, r.worst_mover, r.worst_change) == ("A", "A", "B", -2)
    low = series.leaders(df, ["g"], "e", "o", "cur", "prior", higher_is_better=False).first()
    assert low.leader == "C"


def test_formulas_missing_inputs(spark):
    df = spark.createDataFrame([(1, 3, 100.0, None, 50.0)], "k int, q int, net_commission double, opex double, nwp double")
    got = {r.metric1: r.cur for r in formulas.evaluate(df, ["k"], formulas.COMPANY_METRICS).collect()}
    assert got["Expense Ratio"] == 2 and got["Combined Ratio"] is None and got["Total Overheads"] is None
    f = F.lit
    sign = lambda g, c, n: spark.range(1).select(formulas.signed_cession(f(g), f(c), f(n)).alias("x")).first().x
    assert sign(121.80, -19.37, 102.43) == 19.37  # a bracketed deduction
    assert sign(195.0, -132.0, 327.0) == -132.0  # a reversal


def test_stacked_leaves_out_empty(spark):
    rows = [(1, "a", "x", 3.0, 1.0), (1, "a", "y", 1.0, None), (1, "b", "x", 0.0, None)]
    df = spark.createDataFrame(rows, "p int, c string, s string, cur double, prior double")
    got = {(r.c, r.s): (r.share, r.growth) for r in report.stacked(df, ["p"], "c", "s").collect()}
    assert got == {("a", "x"): (0.75, 3.0), ("a", "y"): (0.25, 3.0)}


def test_mix_of_nothing(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", None), ("b", 1.0), ("b", 2.0)], "g string, v double")
    got = sorted((r.g, r.v if r.v is not None else -1, r.share) for r in rollup.mix_share(df, ["g"], "v").collect())
    assert got == [("a", -1, None), ("a", 0.0, 0.0), ("b", 1.0, 0.3333), ("b", 2.0, 0.6667)]


def test_untraceable(spark):
    texts = spark.createDataFrame([(1, "share 12.3% of 1,234 and 99 or 7"), (2, "none")], "d int, t string")
    values = spark.createDataFrame([(0.1234,), (1234.4,)], "v double")
    got = quality.untraceable(texts, "d", "t", values, "v").collect()
    assert [(r.d, r.token) for r in got] == [(1, "99")]


def test_changed_and_recompute(spark):
    d = spark.createDataFrame([(1, "a"), (2, "b")], "doc int, text string")
    store = docs.with_fingerprint(spark.createDataFrame([(1, "a"), (2, "B")], "doc int, text string"), "text")
    assert [r.doc for r in docs.changed(docs.with_fingerprint(d, "text"), store, "doc").collect()] == [2]


def test_written_tables_are_dropped(spark):
    from peerlens.session import drop_written_tables, written_table

    drop_written_tables(spark)
    kept = written_table(spark.range(5), "drop-test")
    path = kept.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert kept.count() == 5 and os.path.isdir(path)
    assert drop_written_tables(spark) == 1 and not os.path.exists(path)
    assert drop_written_tables(spark) == 0

"""Income statement: sources, variants, pages and missing figures."""

from peerlens.operators import income

ROWS = "doc int, form string, page int, tbl int, r bigint, cells array<string>, fy int, quarter int"
PAGES = "doc int, form string, page int, text string, fy int, quarter int"
HEAD = ["Particulars", "Upto the quarter ended December 31, 2024", "Upto the quarter ended December 31, 2023"]


def table(doc, form, page, *lines, head=HEAD):
    return [(doc, form, page, 0, n, c, 2024, 3) for n, c in enumerate([head, *[list(x) for x in lines]])]


def found(spark, rows, pages=()):
    rows, pages = spark.createDataFrame(rows, ROWS), spark.createDataFrame(list(pages), PAGES)
    return {r.item: (r.cur, r.prior) for r in income.income_statement(rows, pages, ["doc"]).collect()}


def test_variants_pages_and_sums(spark):
    rows = [
        *table(1, "NL-4", 1, ("Gross Direct Premium", "-", "-"), ("Gross Direct Premium", "1,000.00", "500.00"), ("Net Earned", "70.00", "-")),
        *table(1, "NL-1", 2, ("Commission (Net)", "10.00", "20.00"), ("Operating Expenses related to Insurance Business", "30.00", None)),
        *table(1, "NL-7", 5, ("Goods and Service Tax", "12.00"), ("In House Claim Processing Cost", "(8.00)"), head=HEAD[:2]),
        *table(1, "NL-7", 6, ("Goods and Service Tax", "14.00"), ("In House Claim Processing Cost", "-"), head=[HEAD[0], HEAD[2]]),
        *table(1, "NL-6", 4, ("Gross Commission", "-", ""), ("Rewards", "5.00", "-"), ("Distribution fees", "6.00", "3.00"), ("Re-insurance Accepted", "9.00", "-")),
        *table(1, "NL-2", 3, ("OTHER INCOME", "-", "-"), ("(a) Gain", "1.00", "2.00"), ("TOTAL (A)", "99.00", "99.00"),
               ("(f) Contribution to Policyholders' A/c", "", ""), ("(i) Towards", "3.00", "-"), ("(g) Others", "50.00", "50.00"), ("TOTAL (B)", "40.00", "60.00")),
    ]
    out = found(spark, rows)
    assert out["NL-4 GDPI"] == (10.0, 5.0) and out["Gross Written Premium"] == (10.0, 5.0) and out["Earned Premium"] == (0.7, 0.0)
    assert out["GST"] == (0.12, 0.14) and out["In House Claim Processing Cost"] == (0.08, 0.0)
    assert out["Gross Commission"] == (0.11, 0.03) and out["RI Accepted Commission"] == (0.09, 0.0)
    assert out["Other Income"] == (0.01, 0.02) and out["Contribution to Policyholders"] == (0.03, 0.0)
    assert out["Total Overheads"] == (0.76, 0.78)  # a blank figure of a grid is a zero
    assert out["Claims"] == (None, None) and out["Investment Income"] == (None, None) and out["Net Written Premium"] == (None, None)


def test_text_counts_only_without_a_grid(spark):
    header = "Upto the quarter For the quarter For the quarter Upto the quarter\n31st Dec, 2024 31st Dec, 2024 31st Dec, 2023 31st Dec, 2023\n"
    text = header + "Profit Before Tax Exceptional Items 9 9 9 9\nProfit Before Tax ( 1,200.00) 1.00 2.00 600.00\nContribution to Policyholders Funds towards excess EoM 7.00 1.00 1.00 8.00"
    pages = [(1, "NL-2", 3, text, 2024, 3), (1, "NL-4", 1, header + "Gross Direct Premium 5 5 5 5", 2024, 3)]
    out = found(spark, table(1, "NL-4", 1, ("Gross Direct Premium", "100.00", "200.00")), pages)
    assert out["PBT"] == (-12.0, 6.0) and out["NL-4 GDPI"] == (1.0, 2.0) and out["Contribution to Policyholders"] == (0.07, 0.08)
    assert out["Total Overheads"] == (None, None)


def test_nothing_to_read(spark):
    assert found(spark, []) == {}

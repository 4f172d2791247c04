"""Filings rendered from order lines: one per supplier, fiscal year and quarter.

A filing holds the lines of its year up to its quarter, so every line is in at least one. Its number tells its quarter.

The numbers are plain aggregates; what varies is how they are printed (five layouts by supplier number),
so that reading a filing back must give the aggregates again, whatever its layout.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import apart
from ..functions.periods import closing_month, closing_year, fiscal_quarter, fiscal_year, two_digits
from ..sources.tables import read_table
from .panel import line_measures

SEGMENTS = {"A": "Health", "N": "Personal Accident", "R": "Travel"}
GRID_ITEMS = [
    ("Gross Direct Premium", "gross"), ("Add: Premium on reinsurance accepted", "accepted"), ("Net Written Premium", "value"),
    ("Claims Incurred (Net)", "claims"), ("Commission", "commission"),
    ("Operating Expenses related to Insurance Business", "opex"), ("Profit / (Loss) Before Tax", "pbt"),
]
KEYS = ["doc", "fy", "page", "tbl"]


def filing_quarter() -> Column:
    """The quarter that a filing closes with."""
    return (F.floor(F.col("doc") / 3) % 4 + 1).cast("int")


def filing_number(supplier: Column, quarter: Column) -> Column:
    """Number of a supplier's filings for a quarter; filing_quarter reads the quarter back."""
    return (supplier - supplier % 3) * 4 + (quarter - 1) * 3 + supplier % 3


def by_shard(quarters: DataFrame) -> DataFrame:
    """Figures of suppliers by year and quarter with the shard of their supplier, a shard's rows in one partition.

    Whatever is grouped by shard and more from here on stays where it is: a supplier has as many rows as the calendar has
    quarters, so copies for its filings are made behind this exchange and never cross the network.  The number of partitions is
    given: by the size of these few rows alone they would be run together, and the work behind them would get a few tasks.
    """
    parts = int(quarters.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return quarters.withColumn("shard", F.col("supplier") - F.col("supplier") % 3).repartition(parts, "shard")


def in_years(quarters: DataFrame, by: list[str], aggs: Callable[[Column, Column], list[Column]]) -> DataFrame:
    """shard, supplier, fy, by + aggs: each quarter counts for its own year (0) and, as last year's, for the next (1).

    aggs: makes the aggregates from (which of the two, quarter).  _first_0 and _first_1: the first quarter of each.
    """
    both = quarters.where(F.col("q").isNotNull()).withColumn("_s", F.explode(F.array(F.lit(0), F.lit(1))))
    both = both.withColumn("fy", F.col("fy") + F.col("_s"))
    return both.groupBy("shard", "supplier", "fy", *by).agg(
        *aggs(F.col("_s"), F.col("q")), *[F.min(F.when(F.col("_s") == n, F.col("q"))).alias(f"_first_{n}") for n in (0, 1)])


def in_filings(years: DataFrame) -> DataFrame:
    """Years of suppliers in the filings that hold them: doc, _closing and what they had, a row for each quarter they close with.

    Lines without a supplier are in one filing, once for every quarter that they count in.
    """
    closing = F.when(F.col("supplier").isNull(), F.array(F.lit(None).cast("int"))).otherwise(F.sequence(F.least("_first_0", "_first_1"), F.lit(4)))
    out = years.withColumn("_closing", F.explode(closing))
    return out.withColumn("doc", filing_number(F.col("supplier"), F.col("_closing"))).drop("supplier")


def up_to_closing(quarters: list[Column]) -> Column:
    """Exact sum of the quarters' units up to the one that a filing closes with."""
    held = lambda i, v: F.when(F.col("_closing") >= i, v).when(F.col("_closing").isNull(), v * (5 - i))
    parts = [F.coalesce(held(i, v.cast("decimal(19,0)")), F.lit(0).cast("decimal(19,0)")) for i, v in enumerate(quarters, 1)]
    return sum(parts[1:], parts[0]).cast("decimal(29,0)")


def of_closing(quarters: list[Column]) -> Column:
    """Units of the quarter that a filing closes with."""
    out = F.lit(None).cast("bigint")
    for i, v in enumerate(quarters, 1):
        out = F.when(F.col("_closing") == i, v).otherwise(out)
    return F.coalesce(out, F.lit(0)).cast("decimal(29,0)")


SMALL = 1 << 55  # a sum of 16 such figures, 4 of them fourfold, stays within a BIGINT


def all_small(quarters: list[Column]) -> Column:
    """Whether figures of these quarters may be added up as they are."""
    return F.coalesce((F.greatest(*quarters) < SMALL) & (F.least(*quarters) > -SMALL), F.lit(True))


def small_up_to_closing(quarters: list[Column]) -> Column:
    """up_to_closing of small units."""
    none = F.lit(0).cast("bigint")
    held = lambda i, v: F.when(F.col("_closing") >= i, v).when(F.col("_closing").isNull(), v * (5 - i))
    parts = [F.coalesce(held(i, v), none) for i, v in enumerate(quarters, 1)]
    return sum(parts[1:], parts[0])


def small_of_closing(quarters: list[Column]) -> Column:
    """of_closing of small units."""
    return F.coalesce(*[F.when(F.col("_closing") == i, v) for i, v in enumerate(quarters, 1)], F.lit(0).cast("bigint"))


def whole_cents(units: Column) -> Column:
    """Small units as cents, ties away from zero."""
    part = lambda v: F.call_function("div", v + 50, F.lit(100))
    return F.when(units < 0, -part(-units)).otherwise(part(units))


def closes_in() -> Column:
    """Calendar year that this year's filing closes in."""
    return closing_year(F.col("fy"), filing_quarter())


def closing_day(style: str, year: Column) -> Column:
    """The closing day as filers write it: 'December 31, 2025', '31st Dec, 2025' or '31-Dec-25'."""
    day = F.element_at(F.array(*[F.lit(d) for d in ("30", "30", "31", "31")]), filing_quarter())
    month, y = closing_month(filing_quarter()), year.cast("string")
    mon = F.substring(month, 1, 3)
    if style == "long":
        return F.concat(month, F.lit(" "), day, F.lit(", "), y)
    if style == "ordinal":
        return F.concat(day, F.when(day == "31", "st ").otherwise("th "), mon, F.lit(", "), y)
    return F.concat_ws("-", day, mon, two_digits(year))


def line_facts(spark, sf_dir, extra: dict[str, Column] | None = None) -> DataFrame:
    """supplier, fy, q, seg and other keys per order line, with the line's measures in units of 1e-4.

    Lines meet their orders as they are stored; the measures, which are more than what they are made from, are worked out behind
    the exchange.
    """
    m = line_measures()
    # claims of a travel line only would make one segment special: take open lines instead
    m["claims"] = F.when(F.col("l_linestatus") == "O", m["value"]).otherwise(0)
    m["accepted"] = F.when(F.col("l_linestatus") == "F", m["ceded"]).otherwise(0)
    m["opex"] = m["ceded"]
    m["pbt"] = m["value"] - 2 * m["claims"] - m["commission"]
    m["lines"] = F.lit(10_000).cast("bigint")
    orders = read_table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("okey"), F.col("o_orderpriority").alias("channel"),
        fiscal_year("o_orderdate").alias("fy"), fiscal_quarter("o_orderdate").alias("q"))
    met = read_table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "okey").join(orders, "okey")
    out = met.select(
        "okey", F.col("l_suppkey").alias("supplier"), F.col("l_returnflag").alias("flag"),
        F.col("l_linestatus").alias("status"), F.col("l_partkey").alias("partkey"), *[c.alias(n) for n, c in m.items()], "channel", "fy", "q")
    return out.withColumns(extra) if extra else out


def figures(facts: DataFrame, by: list[str], measures: list[str]) -> DataFrame:
    """shard, doc, fy, by + per measure m: m_cc, m_cq, m_pc, m_pq (cumulative / quarter of this and last year), two decimals.

    facts: supplier, fy, q, by, measures. They are added up by quarter before they are copied into filings.
    """
    return filed_figures(by_shard(facts.groupBy("supplier", "fy", "q", *by).agg(*[F.sum(m).alias(m) for m in measures])), by, measures)


def filed_figures(quarters: DataFrame, by: list[str], measures: list[str]) -> DataFrame:
    """The same from sums by_shard, one row per supplier, fy, q and by.

    A figure is null when all that a filing has of its measure is null and of the figure's own period.
    """
    at = lambda m, n: [F.col(f"_{m}_{n}_{i}") for i in (1, 2, 3, 4)]

    def aggs(s: Column, q: Column) -> list[Column]:
        return [F.max(F.when((s == n) & (q == i), F.col(m))).alias(f"_{m}_{n}_{i}") for m in measures for n in (0, 1) for i in (1, 2, 3, 4)]

    closing = F.col("_closing")
    # of each year: whether the filing holds something of it, and of quarters that it does not close with
    held = {f"_any_{n}": F.coalesce(F.col(f"_first_{n}") <= F.coalesce(closing, F.lit(4)), F.lit(False)) for n in (0, 1)}
    held |= {f"_before_{n}": F.coalesce(F.col(f"_first_{n}") < closing, F.lit(False)) for n in (0, 1)}
    filed = in_filings(in_years(quarters, by, aggs)).withColumns(held)
    exact = lambda units: F.round((units / 10_000).cast("decimal(24,4)"), 2).cast("decimal(24,2)")
    cent = F.lit(Decimal("0.01"))
    out = []
    for m in measures:
        for n, k in ((0, "c"), (1, "p")):
            small = all_small(at(m, n))
            cents = lambda few, many, q=at(m, n), small=small: F.when(
                small, (whole_cents(few(q)).cast("decimal(21,0)") * cent).cast("decimal(24,2)")).otherwise(exact(many(q)))
            told = F.coalesce(*[F.when(v.isNotNull(), i) for i, v in enumerate(at(m, n), 1)]) <= F.coalesce(closing, F.lit(4))
            own = F.coalesce(*[F.when(closing == i, v.isNotNull()) for i, v in enumerate(at(m, n), 1)], F.lit(False))
            out.append(F.when(F.col(f"_any_{1 - n}") | told, cents(small_up_to_closing, up_to_closing)).alias(f"{m}_{k}c"))
            out.append(F.when(F.col(f"_any_{1 - n}") | F.col(f"_before_{n}") | closing.isNull() | own, cents(small_of_closing, of_closing)).alias(f"{m}_{k}q"))
    return filed.select("shard", apart(F.col("doc")).alias("doc"), "fy", *by, *out)


def printed(v: Column, split: Column | None = None) -> Column:
    """1,234.50 - brackets for negatives, a dash for nothing, the odd gap inside a figure."""
    text = F.format_number(F.abs(v), 2)
    text = F.when(v < 0, F.concat(F.lit("("), text, F.lit(")"))).otherwise(text)
    if split is not None:
        text = F.when(split, F.regexp_replace(text, r"^(\(?\d{1,3}),", "$1 ,")).otherwise(text)
    return F.when(v.isNull() | (v == 0), F.lit("-")).otherwise(text)


def printed_cents(v: Column, split: Column) -> Column:
    """printed of whole cents."""
    size = F.abs(v)
    text = F.concat(F.format_number(F.call_function("div", size, F.lit(100)), 0), F.lit("."), F.lpad((size % 100).cast("string"), 2, "0"))
    text = F.when(v < 0, F.concat(F.lit("("), text, F.lit(")"))).otherwise(text)
    return F.when(v == 0, F.lit("-")).when(split, F.regexp_replace(text, r"^(\(?\d{1,3}),", "$1 ,")).otherwise(text)


def period_text(style: Column, cumulative: bool, year: Column) -> Column:
    """The header wording differs by filer: three spellings."""
    long = closing_day("long", year)
    a = F.concat(F.lit("Upto the quarter ended " if cumulative else "For the quarter ended "), long)
    b = F.concat(F.lit("For The Period Ended " if cumulative else "For The Quarter Ended "), long)
    c = F.concat(F.lit("Up to the quarter " if cumulative else "For the quarter "), closing_day("short", year))
    return F.when(style == 1, b).when(style == 4, c).otherwise(a)


def _row(r, cells: list[Column] | Column) -> Column:
    cells = F.array(*cells) if isinstance(cells, list) else cells
    return F.struct((r if isinstance(r, Column) else F.lit(r)).cast("bigint").alias("r"), cells.cast("array<string>").alias("cells"))



def statement_grid(spark, sf_dir) -> DataFrame:
    """doc, fy, quarter, page, tbl, r, cells: revenue statements with segments, in five layouts."""
    measures = [m for _, m in GRID_ITEMS]
    seg = F.element_at(F.create_map(*[F.lit(x) for kv in SEGMENTS.items() for x in kv]), F.col("flag"))
    facts = line_facts(spark, sf_dir, {"seg": seg})
    quarters = by_shard(facts.groupBy("supplier", "fy", "q", "seg").agg(*[F.sum(m).alias(m) for m in measures]))
    items = quarters.select("shard", "supplier", "fy", "q", "seg", F.inline(F.array(*[
        F.struct(F.lit(n).alias("item_no"), F.col(m).alias("v")) for n, (_, m) in enumerate(GRID_ITEMS)])))
    columns = [*SEGMENTS.values(), "Total"]
    held = [*SEGMENTS.values(), "other"]  # a quarter has one row of each
    at = lambda c, s, i: F.col(f"_{c}_{s}_{i}")

    def aggs(s: Column, q: Column) -> list[Column]:
        of = lambda c, test: F.max(F.when(test & (F.col("seg").isNull() if c == "other" else F.col("seg") == c), F.col("v")))
        return [of(c, (s == n) & (q == i)).alias(f"_{c}_{n}_{i}") for c in held for n in (0, 1) for i in (1, 2, 3, 4)]

    filed = in_filings(in_years(items, ["item_no"], aggs))
    tests = {"cc": (0, up_to_closing, small_up_to_closing), "cq": (0, of_closing, small_of_closing),
             "pc": (1, up_to_closing, small_up_to_closing), "pq": (1, of_closing, small_of_closing)}
    layout, zero = F.col("doc") % 5, F.lit(0).cast("bigint")
    small = all_small([at(c, n, i) for c in held for n in (0, 1) for i in (1, 2, 3, 4)])

    def quarters_of(c: str, n: int, kind: str) -> list[Column]:
        if c != "Total":
            return [at(c, n, i) for i in (1, 2, 3, 4)]
        each = [[F.coalesce(at(h, n, i).cast(kind), zero.cast(kind)) for h in held] for i in (1, 2, 3, 4)]
        return [sum(e[1:], e[0]) for e in each]

    exact = lambda c, n, of: F.round((of(quarters_of(c, n, "decimal(19,0)")) / 10_000).cast("decimal(24,4)"), 2)

    # figures are BIGINT where they fit: they are many.  Both projections are compiled apart
    every = lambda one: F.array(*[one(*t, c) for t in tests.values() for c in columns])
    cents = every(lambda n, of, few, c: whole_cents(few(quarters_of(c, n, "bigint"))))
    large = every(lambda n, of, few, c: exact(c, n, of))
    told = filed.select(
        apart(F.col("doc")).alias("doc"), "fy", "item_no", layout.alias("layout"), F.when(small, cents).alias("cents"), F.when(~small, large).alias("large"))
    gap, n = F.col("layout") == 4, len(GRID_ITEMS)
    label = F.element_at(F.array(*[F.lit(name) for name, _ in GRID_ITEMS]), F.col("item_no") + 1)

    def shown(at: int) -> Column:
        """The four figures of a block from its first place on."""
        return F.when(F.col("cents").isNotNull(), F.array(*[printed_cents(F.get("cents", F.lit(at + i)), gap) for i in range(len(columns))])).otherwise(
            F.transform(F.slice("large", at + 1, len(columns)), lambda v: printed(v, gap)))

    wide = told.select("doc", "fy", "item_no", label.alias("label"), "layout", *[shown(i * len(columns)).alias(k) for i, k in enumerate(tests)])
    layout, label = F.col("layout"), F.array(F.col("label"))

    def head(k: str) -> Column:
        year = closes_in() if k[0] == "c" else closes_in() - 1
        return F.concat(F.array(period_text(layout, k[1] == "c", year)), F.array_repeat(F.lit(None).cast("string"), 3))

    def arranged(of) -> Column:
        """The four blocks side by side, in the filer's order."""
        cc, cq, pc, pq = (of(k) for k in ("cc", "cq", "pc", "pq"))
        return F.when(layout == 1, F.concat(cq, cc, pq, pc)).when(layout == 2, F.concat(cc, cq, pq, pc)).otherwise(F.concat(cc, cq, pc, pq))

    none = F.array().cast("array<struct<r:bigint,cells:array<string>>>")
    groups = F.array(*[F.lit(s) for s in (*SEGMENTS.values(), "Total")])
    blank, title_cells = F.array(F.lit("")), F.array_repeat(F.lit(None).cast("string"), 16)
    base = F.when(layout == 2, 1).otherwise(0)
    # header rows travel with the first item
    flat_top = F.concat(
        F.when(layout == 2, F.array(_row(0, F.concat(F.array(F.lit("FORM NL-1-B-RA REVENUE ACCOUNT")), title_cells)))).otherwise(none),
        F.array(
            _row(base + F.when(layout == 1, 1).otherwise(0), F.concat(F.array(F.lit("Particulars")), arranged(head))),
            _row(base + F.when(layout == 1, 0).otherwise(1), F.concat(blank, groups, groups, groups, groups)),
            _row(base + 2, F.concat(F.array(F.lit("Gross Direct Premium :")), F.array_repeat(F.lit("-"), 16)))))
    flat = F.concat(
        F.when(F.col("item_no") == 0, flat_top).otherwise(none),
        F.array(_row(base + 3 + F.col("item_no"), F.concat(label, arranged(F.col)))))

    def stack(at: int, ks: tuple[str, str]) -> Column:
        top = F.array(
            _row(at, F.concat(blank, groups, groups)),
            _row(at + 1, F.concat(F.array(F.lit("Particulars")), *[head(k) for k in ks])))
        item = F.array(_row(F.lit(at + 2) + F.col("item_no"), F.concat(label, *[F.col(k) for k in ks])))
        return F.concat(F.when(F.col("item_no") == 0, top).otherwise(none), item)

    rows = F.when(layout == 3, F.concat(stack(0, ("cc", "cq")), stack(n + 2, ("pc", "pq")))).otherwise(flat)
    return wide.select(
        "doc", "fy", filing_quarter().alias("quarter"), F.lit(1).alias("page"), F.lit(0).alias("tbl"), F.inline(rows))


CHANNELS = ["Individual Agents", "Corporate Agents-Banks", "Corporate Agents -Others", "Brokers", "Direct Business", "Web Aggregators"]


def channel_of() -> Column:
    place = F.substring("channel", 1, 1).cast("int")
    return F.when((place == 4) & (F.col("flag") == "R"), 6).otherwise(place)


def channel_grid(spark, sf_dir) -> DataFrame:
    """The channel form: policies and premium per period block; sub-column order and headers vary by filer."""
    facts = line_facts(spark, sf_dir, {"ch": channel_of()})
    base = figures(facts, ["ch", "status"], ["lines", "gross"])
    kinds = ["cq", "cc", "pq", "pc"]
    cols = [f"{m}_{k}" for m in ("lines", "gross") for k in kinds]
    sums = []
    for c in cols:
        for ch in range(1, 7):
            sums.append(F.sum(F.when(F.col("ch") == ch, F.col(c))).alias(f"{c}_{ch}"))
        sums.append(F.sum(F.when((F.col("ch") == 5) & (F.col("status") == "O"), F.col(c))).alias(f"{c}_51"))
        sums.append(F.sum(F.when((F.col("ch") == 5) & (F.col("status") == "F"), F.col(c))).alias(f"{c}_52"))
        sums.append(F.sum(c).alias(f"{c}_all"))
    wide = base.groupBy("shard", "doc", "fy").agg(*sums)
    premium_first, no_year = F.col("doc") % 3 == 0, F.col("doc") % 7 == 0

    def pair(k: str, tag: str, empty: bool = False) -> Column:
        if empty:
            return F.array(F.lit("-"), F.lit("-"))
        lines, gross = printed(F.col(f"lines_{k}_{tag}")), printed(F.col(f"gross_{k}_{tag}"))
        return F.when(premium_first, F.array(gross, lines)).otherwise(F.array(lines, gross))

    def line(r: int, serial: str, label: str, tag: str, empty: bool = False) -> Column:
        return _row(r, F.concat(F.array(F.lit(serial), F.lit(label)), *[pair(k, tag, empty) for k in kinds]))

    def head(k: str) -> Column:
        year = closes_in() if k[0] == "c" else closes_in() - 1
        text = period_text(F.lit(0), k[1] == "c", year)
        if k[0] == "p":
            bare = "Upto the corresponding quarter of the previous year" if k[1] == "c" else "For the corresponding quarter of the previous year"
            text = F.when(no_year, F.lit(bare)).otherwise(text)
        return F.array(text, F.lit(None).cast("string"))

    sub = F.when(premium_first, F.array(F.lit("Premium"), F.lit("No. of Policies"))).otherwise(F.array(F.lit("No. of Policies"), F.lit("Premium")))
    rows = [
        _row(0, F.concat(F.array(F.lit("Sl No"), F.lit("Channels")), *[head(k) for k in kinds])),
        _row(1, F.concat(F.array(F.lit(None).cast("string"), F.lit(None).cast("string")), sub, sub, sub, sub)),
        line(2, "1", "Individual Agents", "1"), line(3, "2", "Corporate Agents-Banks", "2"), line(4, "3", "Corporate Agents -Others", "3"),
        line(5, "4", "Brokers", "4"), line(6, "5", "Direct Business", "5", True), line(7, "", "-Online", "51"), line(8, "", "-Others", "52"),
        line(9, "6.", "Web Aggregators", "6"), line(10, "", "Total (A)", "all"), line(11, "", "Referral (B)", "all", True),
        line(12, "", "Grand Total (A+B)", "all"),
    ]
    return wide.select("doc", "fy", filing_quarter().alias("quarter"), F.lit(2).alias("page"), F.lit(0).alias("tbl"), F.inline(F.array(*rows)))


def claims_grid(spark, sf_dir) -> DataFrame:
    """Paid claims by line of business: a quarter block and a year-to-date block, the latter first for odd filers."""
    facts = line_facts(spark, sf_dir, {"claims_n": F.when(F.col("status") == "O", F.col("lines")).otherwise(0)})
    base = figures(facts, ["flag"], ["claims_n", "claims"])
    wide = base.groupBy("shard", "doc", "fy").agg(*[
        F.sum(F.when(F.col("flag") == f, F.col(f"{m}_{k}"))).alias(f"{m}_{k}_{f}")
        for m in ("claims_n", "claims") for k in ("cc", "cq") for f in SEGMENTS])
    heading = [F.lit("Sl"), F.lit("Line of Business"), F.lit("Total No. of claims paid"), F.lit("Total amount of claims paid")]

    def block(base_r: int, k: str) -> list[Column]:
        rows = [_row(base_r, heading)]
        for i, (f, name) in enumerate(SEGMENTS.items()):
            rows.append(_row(base_r + 1 + i, [F.lit(str(i + 1)), F.lit(name), printed(F.col(f"claims_n_{k}_{f}")), printed(F.col(f"claims_{k}_{f}"))]))
        rows.append(_row(base_r + 4, [F.lit(None), F.lit("Total"), F.lit("9,99,999"), F.lit("9,99,999.00")]))
        return rows

    odd = F.col("doc") % 2 == 1
    title = _row(0, [F.lit("FORM NL-39"), F.lit(None), F.lit(None), F.lit(None)])
    rows = F.when(odd, F.array(title, *block(1, "cc"), *block(6, "cq"))).otherwise(F.array(title, *block(1, "cq"), *block(6, "cc")))
    return wide.select("doc", "fy", filing_quarter().alias("quarter"), F.lit(3).alias("page"), F.lit(0).alias("tbl"), F.inline(rows))


def balance_grid(spark, sf_dir) -> DataFrame:
    """Point-in-time tables: share capital and application money, and the share premium block."""
    base = figures(line_facts(spark, sf_dir), [], ["gross", "accepted", "value", "ceded", "commission"])
    odd = F.col("doc") % 2 == 1
    a = F.concat(F.lit("As at "), closing_day("long", closes_in()))
    b = F.concat(F.lit("As on "), closing_day("short", closes_in() - 1))
    tail = F.lit(None).cast("string")  # a trailing blank column on every form
    cells = lambda label, m: [F.lit(label), F.lit("NL-8"), printed(F.col(f"{m}_cc")), printed(F.col(f"{m}_pc")), tail]
    nl3 = [_row(0, [F.lit("Particulars"), F.lit("Schedule Ref"), a, b, tail]), _row(1, cells("SHARE CAPITAL", "gross")),
           _row(2, cells("SHARE APPLICATION MONEY PENDING ALLOTMENT", "accepted"))]
    blank = [F.lit("3"), F.lit("Share Premium"), tail, tail, tail]
    line = lambda label, m: [tail, F.lit(label), printed(F.col(f"{m}_cc")), printed(F.col(f"{m}_pc")), tail]
    less = [tail, F.lit("Less: utilised"), printed(-F.col("ceded_cc")), printed(-F.col("ceded_pc")), tail]
    head = [_row(0, [F.lit("Sl"), F.lit("Particulars"), a, b, tail]),
            _row(1, [F.lit("2"), F.lit("Capital Reserve"), F.lit("5.00"), F.lit("5.00"), tail]), _row(2, blank)]
    opening = [*head, _row(3, line("Opening Balance", "value")), _row(4, line("Add: additions during the year", "commission")), _row(5, less)]
    closing = [*opening, _row(6, line("Closing Balance", "gross"))]
    end = _row(7, [F.lit("4"), F.lit("General Reserves"), F.lit("7.00"), F.lit("7.00"), tail])
    common = ["doc", "fy", filing_quarter().alias("quarter")]
    both = F.array(
        F.struct(F.lit(4).alias("page"), F.lit(0).alias("tbl"), F.array(*nl3).alias("rows")),
        F.struct(F.lit(5).alias("page"), F.lit(0).alias("tbl"),
                 F.when(odd, F.array(*closing, end)).otherwise(F.array(*opening, end)).alias("rows")))
    return base.select(*common, F.inline(both)).select("doc", "fy", "quarter", "page", "tbl", F.inline("rows"))


INVESTMENT_CODES = ["CGSB", "HTDN", "ECDB", "ECAM", "EGMF", "CTRB", "ICCP", "OEPU", "ZZZZ", "EDCD"]


def investment_grid(spark, sf_dir, misprint: Column | None = None) -> DataFrame:
    """Investments by category code: [investment, income, gross yield, net yield] for two year-to-date blocks.

    misprint: factor of the investments that the total row prints; null leaves them out.
    """
    code = F.col("partkey") % len(INVESTMENT_CODES)
    base = figures(line_facts(spark, sf_dir, {"code": code}), ["code"], ["gross", "commission"])
    kinds = ("cc", "pc")
    wide = base.groupBy("shard", "doc", "fy").agg(
        *[F.sum(F.when(F.col("code") == i, F.col(f"{m}_{k}"))).alias(f"{m}_{k}_{i}")
          for m in ("gross", "commission") for k in kinds for i in range(len(INVESTMENT_CODES))],
        *[F.sum(f"{m}_{k}").alias(f"{m}_{k}_t") for m in ("gross", "commission") for k in kinds])
    none = F.lit(None).cast("string")
    shift = F.col("doc") % 2 == 1  # a leading blank column on odd filers' forms

    def block(k: str, tag: str, printed_yield: bool) -> list[Column]:
        inv, inc = F.col(f"gross_{k}_{tag}"), F.col(f"commission_{k}_{tag}")
        pct = F.round(F.try_divide(inc.cast("double"), inv.cast("double")) * 100, 2)
        shown = F.when(F.col("doc") % 3 != 0, F.concat(pct.cast("string"), F.lit("%"))) if printed_yield else none
        if misprint is not None and tag == "t":
            inv = F.round(inv * misprint, 2)
        return [printed(inv), printed(inc), shown, none]

    def cells(lead: list[Column], ks: list[list[Column]]) -> Column:
        plain = F.array(*lead, *[c for b in ks for c in b]).cast("array<string>")
        return F.when(shift, F.concat(F.array(none), plain)).otherwise(plain)

    heads = [[F.concat(F.lit("Year to date (current year) upto "), closing_day("long", closes_in())), none, none, none],
             [F.concat(F.lit("Year to date (previous year) upto "), closing_day("long", closes_in() - 1)), none, none, none]]
    rows = [_row(0, cells([F.lit("No."), F.lit("Category of Investment"), F.lit("Category Code")], heads))]
    for i, c in enumerate(INVESTMENT_CODES):
        rows.append(_row(1 + i, cells([F.lit(str(i + 1)), F.lit(f"Category {i}"), F.lit(f" {c.lower()} ")], [block(k, str(i), False) for k in kinds])))
    rows.append(_row(1 + len(INVESTMENT_CODES), cells([F.lit("TOTAL"), none, none], [block(k, "t", True) for k in kinds])))
    return wide.select("doc", "fy", filing_quarter().alias("quarter"), F.lit(6).alias("page"), F.lit(0).alias("tbl"), F.inline(F.array(*rows)))


def small_forms(spark, sf_dir) -> DataFrame:
    """Fixed assets, offices and staff, grievances and claims movement of every filing (pages 7 to 10)."""
    flags = {"ch": channel_of()}
    base = figures(line_facts(spark, sf_dir, flags), ["status", "flag"], ["lines", "gross", "accepted"])
    pick = {}
    for s in ("O", "F"):
        for f in SEGMENTS:
            for m in ("lines", "gross"):
                pick[f"{m}_{s}{f}"] = F.sum(F.when((F.col("status") == s) & (F.col("flag") == f), F.col(f"{m}_cc")))
    wide = base.groupBy("shard", "doc", "fy").agg(*[c.alias(n) for n, c in pick.items()], F.sum("lines_cc").alias("lines_all"))
    none = F.lit(None).cast("string")
    g = lambda n: printed(F.col(n))
    odd = F.col("doc") % 2 == 1
    assets = [
        _row(0, [F.lit("FORM NL-14 Fixed Assets"), none, none, none]),
        _row(1, [F.lit("Particulars"), F.lit("Opening"), F.lit("Additions"), F.lit("Deductions")]),
        _row(2, [F.lit("Goodwill"), F.lit("1.00"), F.lit("99.00"), none]), _row(3, [F.lit("Intangibles"), none, none, none]),
        _row(4, [F.lit("a) Software"), F.lit("7.00"), g("gross_OA"), F.lit("1.00")]),
        _row(5, [F.lit("Furniture"), F.lit("7.00"), F.lit("55.00"), none]),
        _row(6, [F.lit("Information Technology Equipment"), F.lit("7.00"), g("gross_FA"), none]),
        _row(7, [F.lit("Work in Progress - Software"), F.lit("7.00"), F.lit("77.00"), none]),
        _row(8, [F.lit("TOTAL"), F.lit("9.00"), F.lit("9,999.00"), none])]
    whole = lambda n: F.format_number(F.col(n), 0)
    gap = lambda n: F.regexp_replace(whole(n), r"^(\d)(\d)", "$1 $2")
    offices = [
        _row(0, [F.lit("1"), F.lit("No. of offices at the beginning of the year"), whole("lines_OA")]),
        _row(1, [F.lit("6"), F.lit("No. of branches at the end of the year"), whole("lines_FA")]),
        _row(2, [F.lit("11"), F.lit("(a) On-roll (b) Off-roll"), F.concat(F.lit("(a) "), F.when(odd, gap("lines_all")).otherwise(whole("lines_all")), F.lit(" (b) 408"))])]
    grievance = [
        _row(0, [F.lit("5"), F.lit("Total no. of claims during current year"), F.lit("0")]),
        _row(1, [F.lit("6"), F.lit("Total No. of Policy Complaints per 10,000 policies"), F.lit("-")]),
        _row(2, [F.lit("5"), F.lit("Total no. of claims during current year"), whole("lines_ON")]),
        _row(3, [F.lit("6"), F.lit("Total No. of Policy Complaints per 10,000 policies"), g("gross_ON")]),
        _row(4, [F.lit("7"), F.lit("Total No. of Claim Complaints per 10,000 claims"), g("gross_FN")])]
    blank_total = lambda n: F.when(odd, none).otherwise(g(n))
    total_rep = printed(F.col("gross_OA") + F.col("gross_FA"))
    movement = [
        _row(0, [F.lit("Amount in Rs. Lakhs"), none]), _row(1, [F.lit("Claims O/S at the beginning of the period"), g("gross_ON")]),
        _row(2, [F.lit("Claims reported during the period"), F.when(odd, none).otherwise(total_rep)]),
        _row(3, [F.lit("(a) Booked during the period"), g("gross_OA")]), _row(4, [F.lit("(b) Reopened during the period"), g("gross_FA")]),
        _row(5, [F.lit("Claims Settled during the period"), g("gross_FN")]),
        _row(6, [F.lit("Claims Repudiated during the period"), F.lit("3.00")]),
        _row(7, [F.lit("Claims O/S at End of the period"), blank_total("gross_OR")]), _row(8, [F.lit("Less than 3 months"), g("gross_OR")])]
    pages = F.array(*[
        F.struct(F.lit(p).alias("page"), F.array(*rows).alias("rows"))
        for p, rows in ((7, assets), (8, offices), (9, grievance), (10, movement))])
    return wide.select("doc", "fy", filing_quarter().alias("quarter"), F.inline(pages)).select(
        "doc", "fy", "quarter", "page", F.lit(0).alias("tbl"), F.inline("rows"))

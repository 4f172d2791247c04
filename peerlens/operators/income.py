"""The whole income statement: lines of five schedules, read from grids and, where a schedule has none, from its text.

All lines of all schedules are matched in one pass over the table rows and one over the text pages.  What is found carries
its rank: grid before text, then the order of the label variants.  One grouping picks the best per line, so a line costs no
job of its own, and a schedule that runs over two pages adds up by itself: each year's figure comes from the page that has it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fixed
from ..functions.numbers import base_plus, convert_units, line_numbers, sum_available
from . import grid, lines

Labels = dict[str, tuple[str, Sequence[Sequence[str]]]]
_STOPS = {"contribution": r"(?i)^\(g\)|total", "other income": r"(?i)total"}  # of a group: label of the row behind it


def _mentions_any(labels: Labels, text: Column) -> Column:
    """Cheap test of a folded row: it may be one of the lines of its schedule."""
    out = F.lit(False)
    for form, variants in labels.values():
        for fragments in variants:
            hit = F.col("form") == form
            for f in fragments:
                hit = hit & text.contains(f.lower())
            out = out | hit
    return out


def grid_lines(rows: DataFrame, by: Sequence[str], labels: Labels) -> DataFrame:
    """by, item, variant, place, cur, prior of every row that a label fits; rows: by, form, page, tbl, r, cells, fy, quarter.

    Only rows that a label fits look up their columns.
    """
    keys = [*by, "form", "page", "tbl"]
    text = F.col("_text")
    met = grid.resolved_rows(rows, keys, only=_mentions_any(labels, grid.row_text(F.col("cells"))))
    met = met.withColumn("_text", grid.row_text(F.col("cells")))
    tests = [
        F.struct(F.lit(item).alias("item"), F.lit(n).alias("variant"),
                 ((F.col("form") == form) & grid.mentions(F.col("cells"), fragments, text=text)).alias("hit"))
        for item, (form, variants) in labels.items() for n, fragments in enumerate(variants)]
    hits = met.select(*keys, "r", "cells", "cur_c", "prior_c", F.explode(F.filter(F.array(*tests), lambda t: t["hit"])).alias("t"))
    at = lambda c: grid.value_at(F.col("cells"), F.col(c))
    return hits.select(*by, "t.item", F.lit(0).alias("source"), "t.variant", F.struct("page", "tbl", "r").alias("place"),
                       at("cur_c").alias("cur"), at("prior_c").alias("prior"))


def text_lines(pages: DataFrame, by: Sequence[str], labels: Labels, exclude: dict[str, Sequence[str]]) -> DataFrame:
    """The same from text pages with their columns (lines.period_columns): the first line of a page that a label fits."""

    def found(item: str, n: int, fragments: Sequence[str]) -> Column:
        line = F.get(F.filter("lines", lambda x: lines._holds(x, fragments, exclude.get(item, ()))), F.lit(0))
        return F.struct(F.lit(item).alias("item"), F.lit(n).alias("variant"), lines.after_label(line, fragments).alias("rest"))

    mine = F.lit(None)
    for form in dict.fromkeys(f for f, _ in labels.values()):  # a page is asked for the lines of its own schedule only
        labelled = F.array(*[found(i, n, v) for i, (of, variants) in labels.items() if of == form for n, v in enumerate(variants)])
        mine = F.when(F.col("form") == form, labelled).otherwise(mine)
    rows = pages.where(F.col("cur_n").isNotNull()).select(*by, "page", "cur_n", "prior_n", F.inline(mine)).where(F.col("rest").isNotNull())
    rows = rows.withColumn("numbers", line_numbers(F.col("rest")))
    place = F.struct(F.col("page"), F.lit(0).alias("tbl"), F.lit(0).cast("bigint").alias("r"))
    at = lambda c: F.get("numbers", F.col(c))
    return rows.select(*by, "item", F.lit(1).alias("source"), "variant", place.alias("place"), at("cur_n").alias("cur"), at("prior_n").alias("prior"))


def best_lines(found: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, item, cur, prior: the best source and variant with a figure; in it a later non-zero figure beats an earlier zero."""
    place = [F.col("place")]
    ranked = found.groupBy(*by, "item", "source", "variant").agg(
        grid._best(F.col("cur"), place).alias("cur"), grid._best(F.col("prior"), place).alias("prior"))
    usable = ranked.where(F.coalesce("cur", "prior").isNotNull())
    return usable.groupBy(*by, "item").agg(F.min_by(F.struct("cur", "prior"), F.struct("source", "variant")).alias("v")).select(*by, "item", "v.*")


def group_sums(rows: DataFrame, pages: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, item, cur, prior: groups of rows of the profit and loss account that only count together."""
    keys = [*by, "form", "page", "tbl"]
    account = rows.where(F.col("form") == "NL-2")
    resolved = grid.resolved_rows(account, keys)
    first = lambda df, item, of: df.groupBy(*by).agg(F.min_by(F.struct("cur", "prior"), of).alias("v")).select(*by, F.lit(item).alias("item"), "v.*")
    place = F.struct("page", "tbl")
    given = grid.sum_after(resolved, keys, ["Contribution to Policyholders"], _STOPS["contribution"])
    other = grid.sum_after(resolved, keys, ["OTHER INCOME"], _STOPS["other income"], include_anchor=True)
    told = lines.sum_lines_after(pages.where(F.col("form") == "NL-2"), [*by, "page"], ["OTHER INCOME"], _STOPS["other income"])
    return first(given, "contribution", place).unionByName(first(other, "other income", place)).unionByName(first(told, "other income", F.col("page")))


def figures(rows: DataFrame, pages: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, item, cur, prior in lakh: every line of fixed_values.INCOME_LINES that was found, and the two groups.

    rows: by, form, page, tbl, r, cells, fy, quarter.  pages: by, form, page, text, fy, quarter; they count for a schedule
    of a filing that has no rows.
    """
    gridless = pages.join(rows.select(*by, "form").distinct(), [*by, "form"], "left_anti")
    gridless = lines.period_columns(gridless)
    found = grid_lines(rows, by, fixed.INCOME_LINES).unionByName(
        text_lines(gridless, by, fixed.INCOME_TEXT_LINES, fixed.INCOME_TEXT_EXCLUDED))
    return best_lines(found, by).unionByName(group_sums(rows, gridless, by))


def statement(found: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, item, cur, prior in crore: the lines as reported and what follows from them.

    A required figure that is missing leaves its sum empty; optional ones count as nothing.
    """
    exact = [F.col(c).cast("decimal(24,4)").alias(c) for c in ("cur", "prior")]
    # as many entries as the statement has lines
    wide = found.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("item", F.struct(*exact)))).alias("_lines"))

    def of(c: str) -> list[tuple[str, Column]]:
        v = lambda n, y=c: F.col("_lines")[n][y]
        parts = [v(n) for n in fixed.COMMISSION_PARTS]
        no_gross = (F.coalesce(v("gross commission", "cur"), F.lit(0)) == 0) & (F.coalesce(v("gross commission", "prior"), F.lit(0)) == 0)
        some = F.lit(False)
        for n in fixed.COMMISSION_PARTS:
            for y in ("cur", "prior"):
                some = some | (F.coalesce(v(n, y), F.lit(0)) != 0)
        gross = F.when(no_gross & some, F.coalesce(sum_exact(parts), v("gross commission"))).otherwise(v("gross commission"))
        beyond = v("total b") - F.coalesce(v("contribution"), F.lit(0))
        overheads = base_exact(v("commission") + v("opex"), beyond, -v("other income"))
        income = sum_exact([v(n) for n in fixed.INVESTMENT_LINES])
        return [
            ("Gross Written Premium", base_exact(v("gross direct premium"), v("reinsurance accepted"))), ("NL-4 GDPI", v("gross direct premium")),
            ("Net Written Premium", v("net written premium")), ("Earned Premium", v("earned premium")), ("Claims", v("claims")),
            ("Net Incurred Claims", v("claims")), ("Operating Expenses", v("opex")), ("Net Commission", v("commission")),
            ("Gross Commission", gross), ("RI Accepted Commission", v("accepted commission")), ("GST", v("gst")),
            ("In House Claim Processing Cost", F.abs(v("in house cost"))), ("PBT", v("pbt")), ("PAT", v("pat")),
            ("CEO Remuneration", v("ceo")), ("Investment Income", income), ("Other Income", v("other income")),
            ("Contribution to Policyholders", v("contribution")), ("Total Overheads", overheads)]

    money = lambda x: convert_units(x, F.lit("money")).cast("double")
    both = F.array(*[F.struct(F.lit(n).alias("item"), money(a).alias("cur"), money(b).alias("prior")) for (n, a), (_, b) in zip(of("cur"), of("prior"))])
    return wide.select(*by, F.inline(both))


def sum_exact(columns: Sequence[Column]) -> Column:
    return sum_available(*columns, zero=F.lit(0).cast("decimal(24,4)"))


def base_exact(base: Column, *optional: Column) -> Column:
    return base_plus(base, *optional, zero=F.lit(0).cast("decimal(24,4)"))


def income_statement(rows: DataFrame, pages: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, item, cur, prior in crore of every filing."""
    return statement(figures(rows, pages, by), by)

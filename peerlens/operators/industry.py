"""Figures of the industry workbook under the conventions of each report slide.

Input is long: keys, sheet, label, col, cur, prev.  Sheet `segment` holds every line of business, sheet
`health` the health lines; personal accident is only in the former and is added where a slide includes it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import growth, ratio


@dataclass(frozen=True)
class Layout:
    """Names the workbook uses."""

    public: Sequence[str]
    peers: Sequence[str]
    general_subtotal: str
    peer_subtotal: str
    special_subtotal: str
    parts: dict[str, str] = field(default_factory=dict)  # short part name -> health column
    accident: str = "P.A."
    total_row: str = "Industry Total"
    total_col: str = "Grand Total"


def _memberships(label: Column, layout: Layout) -> Column:
    """Units a workbook row counts towards, with sign: general subtotal less the public ones is private."""
    unit = lambda name, sign=1: F.struct(F.lit(name).alias("unit"), F.lit(sign).alias("sign"))
    own = F.struct(label.alias("unit"), F.lit(1).alias("sign"))
    return (
        F.when(label.isin(*layout.peers), F.array(unit("SAHI"), own))
        .when(label.isin(*layout.public), F.array(unit("Public"), unit("Private", -1)))
        .when(label == layout.general_subtotal, F.array(unit("Private")))
        .when(label == layout.peer_subtotal, F.array(unit("SAHI subtotal")))
        .when(label == layout.special_subtotal, F.array(unit("Specialized Insurer")))
        .when(label == layout.total_row, F.array(unit("Industry")))
    )


def units(sheets: DataFrame, keys: Sequence[str], layout: Layout) -> DataFrame:
    """One wide row per keys and unit: every column of both sheets, this year (c_*) and last (p_*)."""
    name = F.concat("sheet", F.lit("|"), "col")
    rows = sheets.select(*keys, name.alias("_n"), "cur", "prev", F.inline(_memberships(F.col("label"), layout)))
    signed = lambda c: F.col("sign") * F.coalesce(F.col(c).cast("decimal(24,4)"), F.lit(0))
    sums = rows.groupBy(*keys, "unit", "_n").agg(
        F.sum(signed("cur")).cast("double").alias("c"), F.sum(signed("prev")).cast("double").alias("p"))
    # a unit has as many entries as the workbook has columns
    return sums.groupBy(*keys, "unit").agg(
        F.map_from_entries(F.collect_list(F.struct("_n", F.struct("c", "p")))).alias("f"))


def _exact(*values: Column) -> Column:
    total = F.lit(0).cast("decimal(24,4)")
    for v in values:
        total = total + F.coalesce(v.cast("decimal(24,4)"), F.lit(0))
    return total.cast("double")


def slides(sheets: DataFrame, keys: Sequence[str], layout: Layout) -> DataFrame:
    """keys, slide, company, metric1, metric2, cur, prior for slides 3 to 11 and 14.

    All figures of a unit are in its one wide row, so every slide is a projection of it.
    """
    u = units(sheets, keys, layout)
    name, parts = F.col("unit"), list(layout.parts)
    fig = lambda sheet, col: F.try_element_at("f", F.lit(f"{sheet}|{col}"))
    part = {p: fig("health", col) for p, col in layout.parts.items()} | {"PA": fig("segment", layout.accident)}
    whole, health = fig("segment", layout.total_col), fig("health", layout.total_col)
    incl = {s: _exact(health[s], part["PA"][s]) for s in ("c", "p")}
    total = {s: _exact(*[v[s] for v in part.values()]) for s in ("c", "p")}
    rise = growth(incl["c"], incl["p"])

    def share(p: str, s: str) -> Column:
        v = part[p][s]
        return F.when((total[s] == 0) & (v == 0), F.lit(0.0)).otherwise(ratio(v, total[s]))

    def row(when: Column, slide: int, company, metric1, metric2, cur: Column, prior: Column) -> Column:
        text = lambda v: v if isinstance(v, Column) else F.lit(v)
        return F.when(when, F.struct(
            F.lit(slide).alias("slide"), text(company).alias("company"), text(metric1).alias("metric1"),
            text(metric2).cast("string").alias("metric2"), cur.cast("double").alias("cur"), prior.cast("double").alias("prior")))

    is_peer, peer_like = name.isin(*layout.peers), name.isin("SAHI", *layout.peers)
    is_group, is_industry = name.isin("Private", "Public", "SAHI"), name == "Industry"
    none, mix, r2 = F.lit(None), "Segment-wise GDPI mix", lambda v: F.round(v, 2)
    first = part[parts[0]]
    rows = [
        row(name.isin("Private", "Public", "Specialized Insurer"), 3, "Industry", "Market share", name, r2(whole["c"]), r2(whole["p"])),
        row(name == "SAHI subtotal", 3, "Industry", "Market share", "SAHI", r2(whole["c"]), r2(whole["p"])),
        row(is_group, 4, "Health Industry", "Market share", name, r2(incl["c"]), r2(incl["p"])),
        row(is_peer, 5, "SAHI Market", "Market share", name, r2(incl["c"]), r2(incl["p"])),
        row(is_industry, 8, "Industry Total", "Growth %", "", rise, F.lit(0.0)),
        row(name == "SAHI subtotal", 8, "SAHI subtotal", "Growth %", "", growth(whole["c"], whole["p"]), F.lit(0.0)),
        row(peer_like, 9, name, "SAHI Growth", "GDPI Growth SAHI", F.round(rise, 4), none),
        row(is_peer, 14, name, "Retail Revenue", "", first["c"], first["p"]),
        row(is_peer, 14, name, "Retail Accretion", "Retail Revenue CY-Retail Revenue PY",
            F.round(first["c"].cast("decimal(24,4)") - first["p"].cast("decimal(24,4)"), 2), none),
    ]
    for p, v in part.items():
        rows += [
            row(is_industry, 4, "Health Industry", "Market share", p, r2(v["c"]), r2(v["p"])),
            row(is_group, 6, name, "Market share", p, v["c"], v["p"]),
            row(is_peer, 7, name, "Market share", p, v["c"], v["p"]),
            row(name.isin("Private", "Public", "Industry"), 10, mix, name, p, v["c"], v["p"]),
            row(name == "SAHI", 10, mix, name, p, share(p, "c"), share(p, "p")),
            row(peer_like, 11, mix + " - SAHI", name, p, share(p, "c"), share(p, "p")),
        ]
    entries = F.filter(F.map_entries("f"), lambda e: e["key"].startswith("segment|") & (e["key"] != f"segment|{layout.total_col}"))
    columns = F.when(is_industry, F.transform(entries, lambda e: F.struct(
        F.lit(3).alias("slide"), F.lit("Industry").alias("company"), F.lit("Market share").alias("metric1"),
        F.split_part(e["key"], F.lit("|"), F.lit(2)).alias("metric2"), r2(e["value"]["c"]).alias("cur"), r2(e["value"]["p"]).alias("prior"))))
    printed = F.concat(F.filter(F.array(*rows), lambda x: x.isNotNull()), F.coalesce(columns, F.array().cast(_ROW)))
    return u.select(*keys, F.inline(printed))


_ROW = "array<struct<slide:int,company:string,metric1:string,metric2:string,cur:double,prior:double>>"

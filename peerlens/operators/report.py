"""Chart-ready report tables: shares, totals, panels and trends, one DataFrame per slide."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import display_growth, growth
from ..functions.periods import fy_end_label, trend_label
from .series import cap_for, exact_sum

SEGMENT_LABEL_FROM = 0.04  # smaller segments carry no label
SLICE_LABEL_FROM = 0.03


def stacked(
    df: DataFrame, by: Sequence[str], category: str, series: str, shown_totals: DataFrame | None = None,
    label_from: float = SEGMENT_LABEL_FROM,
) -> DataFrame:
    """Shares of each category's total in both periods, totals, growth of totals and label flags.

    Categories with nothing to show in either period are left out; with `shown_totals` (by, category,
    shown, shown_prior) so are those whose shown total is zero.
    """
    keys = [*by, category]
    sums = df.groupBy(*keys).agg(exact_sum(F.col("cur")).alias("total"), exact_sum(F.col("prior")).alias("total_prior"),
                                 F.bool_or((F.coalesce("cur", F.lit(0.0)) != 0) | (F.coalesce("prior", F.lit(0.0)) != 0)).alias("_any"))
    sums = sums.where("_any").drop("_any")
    if shown_totals is not None:
        sums = sums.join(shown_totals.select(*keys, "shown", "shown_prior"), keys, "left")
        sums = sums.where(F.coalesce(F.col("shown"), F.lit(1.0)) != 0)
    share = F.try_divide(F.col("cur"), F.col("total"))
    out = df.join(sums, keys)
    extra = ["shown", "shown_prior"] if shown_totals is not None else []
    return out.select(
        *keys, series, "cur", "prior", share.alias("share"), F.try_divide(F.col("prior"), F.col("total_prior")).alias("share_prior"),
        "total", "total_prior", *extra,
        display_growth(F.coalesce("total", F.lit(0.0)), F.col("total_prior")).alias("growth"),
        F.coalesce(share >= label_from, F.lit(False)).alias("labelled"))


def panels(long: DataFrame, by: Sequence[str], entity: str, scales: dict[str, float], lower_is_better: Sequence[str]) -> DataFrame:
    """Metric panels: scaled figures of the entities that have any, whether last year is drawn, and the leader."""
    scale = F.lit(1.0)
    for name, factor in scales.items():
        scale = F.when(F.col("metric1") == name, F.lit(factor)).otherwise(scale)
    rows = long.where(F.coalesce("cur", "prior").isNotNull()).select(
        *by, "metric1", entity, (F.col("cur") * scale).alias("cur"), (F.col("prior") * scale).alias("prior"))
    low = F.col("metric1").isin(*lower_is_better) if lower_is_better else F.lit(False)
    keys = [*by, "metric1"]
    ends = rows.groupBy(*keys).agg(
        F.bool_or(F.col("prior").isNotNull()).alias("two_bars"), F.max("cur").alias("_hi"), F.min("cur").alias("_lo"))
    best = F.when(low, F.col("_lo")).otherwise(F.col("_hi"))
    return rows.join(ends, keys).withColumn("leads", F.coalesce(F.col("cur") == best, F.lit(False))).drop("_hi", "_lo")


def trends(
    ytd: DataFrame, entity: str, titles: Sequence[str], periods: Sequence[tuple[int, int]], annualized: Sequence[str] = ()
) -> DataFrame:
    """report_fy, report_q, title, entity, label, value for each reporting period (fy, quarter) asked for.

    A report shows the years completed by then and, in its first three quarters, its own point; flow
    metrics named in `annualized` are scaled to a full year there.  ytd: entity, fy, q and one column
    per title.  Each row knows the reports it belongs to, so there is no join and one pass.
    """
    months = F.col("q") * 3
    scaled = {t: F.col(t) * (12 / months) for t in annualized}
    long = ytd.withColumns(scaled) if scaled else ytd
    return in_reports(long, periods).unpivot(["report_fy", "report_q", entity, "label"], list(titles), "title", "value").where(
        F.col("value").isNotNull())


def in_reports(df: DataFrame, periods: Sequence[tuple[int, int]], fy: str = "fy", q: str = "q") -> DataFrame:
    """One copy of a year-to-date row per report that shows it, with report_fy, report_q and its label."""
    reports = F.array(*[F.struct(F.lit(y).alias("report_fy"), F.lit(n).alias("report_q")) for y, n in periods])
    year, quarter = F.col(fy), F.col(q)

    def shows(r: Column) -> Column:
        completed = (quarter == 4) & (year + 1 <= cap_for(r["report_fy"], r["report_q"]))
        own = (quarter < 4) & (r["report_fy"] == year) & (r["report_q"] == quarter)
        return completed | own

    label = F.when(quarter == 4, fy_end_label(year)).otherwise(trend_label(year, quarter))
    return df.withColumn("label", label).select("*", F.inline(F.filter(reports, shows)))


def statement(wide: DataFrame, keys: Sequence[str], lines: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Statement pivot: one column per line and period."""
    return wide.select(*keys, *[c.alias(n) for n, (c, _) in lines.items()], *[p.alias(f"{n}_prior") for n, (_, p) in lines.items()])


def period_points(
    rows: DataFrame, titles: DataFrame, periods: Sequence[str], peers: Sequence[str], order: str, entity: str = "company",
) -> DataFrame:
    """periods, title, entity, value: this period's point of every title of the history.

    titles: title, slide, metric1, kind.  The first row by `order` of an entity counts.  `Peers` is the sum over the peers,
    of both years before anything is derived from it.  kind: value as it is, annual scaled to a year, growth on last year.
    """
    quarter = F.col(periods[-1])
    own = rows.join(titles, ["slide", "metric1"]).groupBy(*periods, "title", "kind", entity).agg(
        F.min_by(F.struct("cur", "prior"), order).alias("_v")).select(*periods, "title", "kind", entity, "_v.cur", "_v.prior")
    whole = lambda c: F.sum(F.col(c).cast("decimal(38,4)")).cast("double").alias(c)
    summed = own.where(F.col(entity).isin(*peers)).groupBy(*periods, "title", "kind").agg(whole("cur"), whole("prior"))
    both = own.unionByName(summed.withColumn(entity, F.lit("Peers")))
    value = (
        F.when(F.col("kind") == "growth", growth(F.col("cur"), F.col("prior")))
        .when(F.col("kind") == "annual", F.col("cur") * (12 / (quarter * 3))).otherwise(F.col("cur")))
    return both.withColumn("value", value).where(F.col("value").isNotNull()).select(*periods, "title", entity, "value")

"""Time series and ranking operators over metric tables.

Totals and endpoints are computed by grouping (partial sums before the shuffle) and joined
back, so a period or title that holds most of the rows is never gathered in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import growth
from ..functions.periods import months_elapsed

MONEY = "decimal(24,4)"


def exact_sum(value: Column) -> Column:
    """Order-independent sum of four-decimal money, as DOUBLE."""
    return F.sum(value.cast(MONEY)).cast("double")


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Equi join in which a null key meets a null key; right-hand keys are dropped."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(renamed[f"_r_{k}"])
    return left.join(renamed, cond, how).drop(*[f"_r_{k}" for k in keys])


def with_totals(df: DataFrame, by: Sequence[str], totals: dict[str, str]) -> DataFrame:
    """Adds, for each new -> value, the exact total of value over `by`."""
    sums = df.groupBy(*by).agg(*[exact_sum(F.col(v)).alias(new) for new, v in totals.items()])
    return df.join(sums, list(by))


def year_on_year(df: DataFrame, by: Sequence[str], cur: str, prior: str) -> DataFrame:
    """Growth, share of the period's total in both years and the change in share points."""
    present = F.when(F.col(prior).isNotNull(), F.col(prior))
    out = with_totals(df.withColumn("_p", present), by, {"_tc": cur, "_tp": "_p"})
    share, share_prior = F.try_divide(F.col(cur), F.col("_tc")), F.try_divide(F.col(prior), F.col("_tp"))
    return out.withColumns(
        {
            "growth": growth(F.col(cur), F.col(prior)),
            "share": share,
            "share_prior": share_prior,
            "share_change": (share - share_prior) * 100,
        }
    ).drop("_p", "_tc", "_tp")


def year_to_date(df: DataFrame, keys: Sequence[str], values: Sequence[str], fy: str = "fy", q: str = "q") -> DataFrame:
    """Cumulative figure within the fiscal year; a partition holds at most four quarters."""
    w = Window.partitionBy(*keys, fy).orderBy(q).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({v: F.sum(F.col(v).cast(MONEY)).over(w).cast("double") for v in values})


def monthly_run_rate(value: Column, quarter: Column) -> Column:
    return value / months_elapsed(quarter)


def annualized(value: Column, quarter: Column) -> Column:
    """Year-to-date flow scaled to a full year."""
    return value * (12 / months_elapsed(quarter))


def cap_years(history: DataFrame, cap: Column, fy_end: str = "fy_end") -> DataFrame:
    """Only years the reporting period has completed."""
    return history.where(F.col(fy_end) <= cap)


def cap_for(fy: Column, quarter: Column) -> Column:
    """Last complete year of a reporting period: its own end year at the last quarter, else one less."""
    return F.when(quarter == 4, fy + 1).otherwise(fy)


def cagr(history: DataFrame, title: str, entity: str, fy_end: str, value: str) -> DataFrame:
    """Compound growth between the title's first and last year, for a positive base."""
    ends = history.groupBy(title).agg(F.min(fy_end).alias("first_year"), F.max(fy_end).alias("last_year"))
    ends = ends.where(F.col("last_year") > F.col("first_year"))
    points = history.join(ends, title).where(F.col(fy_end).isin(F.col("first_year"), F.col("last_year")))
    both = points.groupBy(title, entity, "first_year", "last_year").agg(
        F.max(F.when(F.col(fy_end) == F.col("first_year"), F.col(value))).alias("first_value"),
        F.max(F.when(F.col(fy_end) == F.col("last_year"), F.col(value))).alias("last_value"),
    )
    years = F.col("last_year") - F.col("first_year")
    return both.where((F.col("first_value") > 0) & F.col("last_value").isNotNull()).withColumn(
        "cagr", F.round(F.pow(F.col("last_value") / F.col("first_value"), 1.0 / years) - 1, 8)
    )


def leaders(
    df: DataFrame, by: Sequence[str], entity: str, order: str, cur: str, prior: str, higher_is_better: bool = True
) -> DataFrame:
    """Leader, best mover and worst mover per group; ties go to the entity first in order."""
    change = F.when(F.col(cur).isNotNull() & F.col(prior).isNotNull(), F.col(cur) - F.col(prior))
    base = df.where(F.col(cur).isNotNull()).withColumn("_d", change)
    who = F.struct(F.col(entity).alias("entity"), F.col(cur).alias("cur"), F.col("_d").alias("change"))
    up = lambda v: F.when(v.isNotNull(), F.struct(v.alias("v"), (-F.col(order)).alias("o")))
    down = lambda v: F.when(v.isNotNull(), F.struct(v.alias("v"), F.col(order).alias("o")))
    top = F.max_by(who, up(F.col(cur))) if higher_is_better else F.min_by(who, down(F.col(cur)))
    out = base.groupBy(*by).agg(
        top.alias("_top"), F.max_by(who, up(F.col("_d"))).alias("_best"), F.min_by(who, down(F.col("_d"))).alias("_worst")
    )
    worst_counts = (F.col("_worst.change") < -1e-9) & (F.col("_worst.entity") != F.col("_best.entity"))
    return out.select(
        *by,
        F.col("_top.entity").alias("leader"),
        F.col("_top.cur").alias("leader_value"),
        F.when(F.col("_best.change") > 1e-9, F.col("_best.entity")).alias("best_mover"),
        F.when(F.col("_best.change") > 1e-9, F.col("_best.change")).alias("best_change"),
        F.when(worst_counts, F.col("_worst.entity")).alias("worst_mover"),
        F.when(worst_counts, F.col("_worst.change")).alias("worst_change"),
    )


def insight_rows(df: DataFrame, by: Sequence[str], **kw) -> DataFrame:
    """leaders() as up to three rows per group: 1 leader, 2 best mover, 3 worst mover."""
    lead = leaders(df, by, **kw)
    rows = F.array(
        F.struct(F.lit(1).alias("line"), F.lit("leader").alias("kind"), F.col("leader").alias("entity"),
                 F.col("leader_value").alias("number")),
        F.struct(F.lit(2).alias("line"), F.lit("improved").alias("kind"), F.col("best_mover").alias("entity"),
                 F.col("best_change").alias("number")),
        F.struct(F.lit(3).alias("line"), F.lit("declined").alias("kind"), F.col("worst_mover").alias("entity"),
                 F.col("worst_change").alias("number")),
    )
    return lead.select(*by, F.inline(F.filter(rows, lambda r: r["entity"].isNotNull())))


def ranked(df: DataFrame, by: Sequence[str], value: str, higher_is_better: bool = True, ranges: int = 64) -> DataFrame:
    """Dense rank within a group, in two steps so that a large group is not ordered in one task.

    The distinct values of a group fall into ranges between quantiles of the group, so a range holds about the same
    share of it however the values lie; a value's rank is the number of values in better ranges plus its place inside
    its own range.
    """
    by = list(by)
    places = df.where(F.col(value).isNotNull()).select(*by, value).distinct()
    cuts = places.groupBy(*by).agg(
        F.array_distinct(F.percentile_approx(value, [i / ranges for i in range(1, ranges)], 100 * ranges)).alias("_cuts"))
    places = places.join(cuts, by)
    up = F.size(F.filter("_cuts", lambda c: c < F.col(value)))
    places = places.withColumn("_b", -up if higher_is_better else up).drop("_cuts")
    counts = places.groupBy(*by, "_b").agg(F.count("*").alias("_n"))
    better = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*by, "_b", F.coalesce(F.sum("_n").over(better), F.lit(0)).alias("_before"))
    order = F.col(value).desc() if higher_is_better else F.col(value).asc()
    inside = F.row_number().over(Window.partitionBy(*by, "_b").orderBy(order))
    rank = places.withColumn("_in", inside).join(counts, [*by, "_b"])
    rank = rank.select(*by, value, (F.col("_before") + F.col("_in")).cast("int").alias("rank"))
    return df.join(rank, [*by, value])


def distinct_median(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Exact median of the distinct positive values per group, without sorting a group in one task.

    Values fall into fine logarithmic ranges; counts of ranges (not values) are scanned to find the
    ranges of the two middle places, and only the values of those ranges are ordered.
    """
    by = list(by)
    v = df.where(F.col(value) > 0).select(*by, F.col(value).alias("_v")).distinct()
    v = v.withColumn("_b", F.floor(F.log(F.col("_v")) * 1024))
    counts = v.groupBy(*by, "_b").agg(F.count("*").alias("_n"))
    upto = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    counts = counts.withColumns({"_end": F.sum("_n").over(upto), "_all": F.sum("_n").over(whole)})
    lower, upper = F.floor((F.col("_all") + 1) / 2), F.floor((F.col("_all") + 2) / 2)
    start = F.col("_end") - F.col("_n")
    middle = counts.where(
        ((lower > start) & (lower <= F.col("_end"))) | ((upper > start) & (upper <= F.col("_end")))
    ).select(*by, "_b", start.alias("_start"), lower.alias("_lo"), upper.alias("_hi"), F.col("_all").alias("_count"))
    place = Window.partitionBy(*by, "_b").orderBy("_v")
    picked = v.join(middle, [*by, "_b"]).withColumn("_rank", F.col("_start") + F.row_number().over(place))
    return (
        picked.where(F.col("_rank").isin(F.col("_lo"), F.col("_hi")))
        .groupBy(*by, "_count")
        .agg((F.sum("_v") / F.count("*")).alias("median"))
        .withColumnRenamed("_count", "positives")
    )


def outlier_split(df: DataFrame, by: Sequence[str], value: str, times: float = 5.0) -> DataFrame:
    """Where a value axis should break: highest normal and highest outlying value, if both exist."""
    med = distinct_median(df, by, value).where(F.col("positives") >= 2)
    joined = df.where(F.col(value) > 0).join(med, list(by))
    over = F.col(value) > F.col("median") * times
    return (
        joined.groupBy(*by, "median")
        .agg(F.max(F.when(~over, F.col(value))).alias("normal_max"), F.max(F.when(over, F.col(value))).alias("outlier_max"))
        .where(F.col("normal_max").isNotNull() & F.col("outlier_max").isNotNull())
    )


def lane_scale(df: DataFrame, by: Sequence[str], value: str, damping: float = 0.4) -> DataFrame:
    """Each series scaled to 0..1 around one half, flat series in the middle, damped towards it."""
    ends = df.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    frac = F.when(F.col("_hi") == F.col("_lo"), F.lit(0.5)).otherwise(
        F.try_divide(F.col(value) - F.col("_lo"), F.col("_hi") - F.col("_lo"))
    )
    return df.join(ends, list(by)).withColumn("lane", F.lit(0.5) + (frac - 0.5) * damping).drop("_lo", "_hi")


def trend_with_point(history: DataFrame, point: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """Capped history followed by the period's own point, unless history holds that label already."""
    return history.unionByName(point.join(history, [*keys, label], "left_anti"))


def opening_closing_average(opening: Column, closing: Column) -> Column:
    """Average of both counts, else whichever one exists; zero counts as missing."""
    a, b = F.nullif(opening, F.lit(0.0)), F.nullif(closing, F.lit(0.0))
    return F.coalesce((a + b) / 2, a, b)


def accretion(cur: Column, prior: Column) -> Column:
    return F.round(cur - prior, 2)


def not_meaningful(rate: Column, limit: float = 2.0) -> Column:
    """'NM' beyond the limit in either direction, 'OK' otherwise, null without a rate."""
    return F.when(F.abs(rate) > limit, "NM").when(rate.isNotNull(), "OK")



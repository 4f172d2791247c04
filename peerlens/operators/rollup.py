"""Rollups, residuals, mixes and pivots of metric tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import ratio
from .series import exact_sum, with_totals


def group_total(df: DataFrame, by: Sequence[str], member: Column, value: str, name: str = "total") -> DataFrame:
    """Sum over the members of a group; a missing value counts as zero, no member gives zero."""
    return df.groupBy(*by).agg(
        exact_sum(F.when(member, F.coalesce(F.col(value), F.lit(0.0))).otherwise(0.0)).alias(name)
    )


def subtotal_residual(df: DataFrame, by: Sequence[str], member: Column, value: str) -> DataFrame:
    """Members' total and what the subtotal holds beside it."""
    inside = exact_sum(F.when(member, F.coalesce(F.col(value), F.lit(0.0))).otherwise(0.0))
    outside = exact_sum(F.when(member, F.lit(0.0)).otherwise(F.coalesce(F.col(value), F.lit(0.0))))
    return df.groupBy(*by).agg(inside.alias("members"), outside.alias("residual"), exact_sum(F.col(value)).alias("subtotal"))


def others_residual(df: DataFrame, by: Sequence[str], part: str, named: Sequence[str], value: str) -> DataFrame:
    """Total minus the named parts at two decimals; null when any named part is missing."""
    is_named = F.col(part).isin(*named)
    out = df.groupBy(*by).agg(
        exact_sum(F.col(value)).alias("total"),
        exact_sum(F.when(is_named, F.col(value))).alias("_named"),
        F.count_distinct(F.when(is_named & F.col(value).isNotNull(), F.col(part))).alias("_found"),
    )
    residual = F.round(F.col("total").cast("decimal(24,4)") - F.col("_named").cast("decimal(24,4)"), 2).cast("double")
    return out.withColumn("others", F.when(F.col("_found") == len(named), residual)).drop("_named", "_found")


def available_total(df: DataFrame, by: Sequence[str], value: str, name: str = "total") -> DataFrame:
    """Sum of what is present; null only when nothing is."""
    return df.groupBy(*by).agg(exact_sum(F.col(value)).alias(name))


def mix_share(df: DataFrame, by: Sequence[str], value: str, name: str = "share", digits: int = 4) -> DataFrame:
    """Share of the entity's own total; a zero value of a zero total is a zero share."""
    out = with_totals(df, by, {"_total": value})
    v, total = F.col(value), F.col("_total")
    return out.withColumn(
        name, F.when((total == 0) & (v == 0), F.lit(0.0)).otherwise(ratio(v, total, digits))
    ).drop("_total")


def mixed_convention(df: DataFrame, by: Sequence[str], value: str, as_share: Column, name: str = "figure") -> DataFrame:
    """Shares for the groups in `as_share`, absolute values for all others."""
    out = mix_share(df, by, value, "_share")
    return out.withColumn(name, F.when(as_share, F.col("_share")).otherwise(F.col(value))).drop("_share")


def share_of_base(
    parts: DataFrame, base: DataFrame, keys: Sequence[str], bucket: str, value: str, base_value: str, digits: int = 4
) -> DataFrame:
    """Bucket totals as a fraction of a base figure held elsewhere."""
    sums = parts.groupBy(*keys, bucket).agg(exact_sum(F.col(value)).alias(value))
    return sums.join(base.select(*keys, base_value), list(keys), "left").withColumn(
        "share", ratio(F.col(value), F.col(base_value), digits)
    )


def classify(df: DataFrame, dim: DataFrame, key: str, bucket: str, unclassified: str = "Others (unclassified)") -> DataFrame:
    """Joins a bucket dimension; rows it does not know fall into the unclassified bucket."""
    return df.join(dim.select(key, bucket), key, "left").withColumn(bucket, F.coalesce(F.col(bucket), F.lit(unclassified)))


def named_or_others(column: Column, named: Sequence[str], others: str = "Others") -> Column:
    return F.when(column.isin(*named), column).otherwise(F.lit(others))


def relabel(column: Column, groups: dict[str, Sequence[str]], default: Column | None = None) -> Column:
    """Member label to group label by a fixed mapping."""
    out = default if default is not None else F.lit(None).cast("string")
    for label, members in groups.items():
        out = F.when(column.isin(*members), F.lit(label)).otherwise(out)
    return out


def with_all_row(
    df: DataFrame, by: Sequence[str], entity: str, measures: Sequence[str], label: str = "Industry"
) -> DataFrame:
    """Per-entity sums plus one row over all entities, in one grouping-sets pass."""
    cols = [*by, entity]
    sets = [[F.col(c) for c in cols], [F.col(c) for c in by]]
    out = df.groupingSets(sets, *[F.col(c) for c in cols]).agg(
        F.grouping(entity).alias("_all"), *[exact_sum(F.col(m)).alias(m) for m in measures]
    )
    return out.withColumn(entity, F.when(F.col("_all") == 1, F.lit(label)).otherwise(F.col(entity))).drop("_all")


def rolled_up(df: DataFrame, levels: Sequence[str], measures: Sequence[str], label: str = "All") -> DataFrame:
    """Totals at every level of a hierarchy; a level that is summed over carries the label."""
    out = df.rollup(*levels).agg(
        *[F.grouping(c).alias(f"_g_{c}") for c in levels], *[exact_sum(F.col(m)).alias(m) for m in measures]
    )
    return out.withColumns(
        {c: F.when(F.col(f"_g_{c}") == 1, F.lit(label)).otherwise(F.col(c).cast("string")) for c in levels}
    ).drop(*[f"_g_{c}" for c in levels])


def pivot_last(
    df: DataFrame, by: Sequence[str], label: str, values: Sequence[str], value: str, order: str
) -> DataFrame:
    """One column per label value; on duplicates the row latest in order wins, null or not."""
    return df.groupBy(*by).agg(
        *[F.max_by(F.struct(F.col(value).alias("v")), F.when(F.col(label) == lv, F.col(order)))["v"].alias(name)
          for lv, name in _named(values)]
    )


def _named(values: Sequence[str]) -> list[tuple[str, str]]:
    return [(v, v.lower().replace(" ", "_").replace("-", "_")) for v in values]


def metric_series(
    df: DataFrame, entity_order: DataFrame, entity: str, metric1: str, metric2: str | None, keys: Sequence[str] = ()
) -> DataFrame:
    """cur and prior of one metric for the known entities, in their order, entities without data left out.

    metric2 None matches any second label; the first row of an entity is taken.
    """
    rows = df.where(F.col("metric1") == metric1)
    if metric2 is not None:
        rows = rows.where(F.col("metric2") == metric2)
    first = rows.groupBy(*keys, entity).agg(F.min_by(F.struct("cur", "prior"), F.col("row_no")).alias("_p"))
    out = first.select(*keys, entity, F.col("_p.cur").alias("cur"), F.col("_p.prior").alias("prior"))
    out = out.where(F.coalesce("cur", "prior").isNotNull())
    return out.join(entity_order, entity)


def missing_audit(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows lacking a value in either period, per entity; blank rows are not counted."""
    populated = df.where(F.coalesce(F.col("slide").cast("string"), F.col("category")).isNotNull())
    lacking = F.col("cur").isNull() | F.col("prior").isNull()
    return populated.groupBy(*by).agg(F.count_if(lacking).alias("missing")).where(F.col("missing") > 0)

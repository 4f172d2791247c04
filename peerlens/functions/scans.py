"""Ordered scans that never put one whole group into one task.

A plain window over (keys) sorts every row of a group in a single task.  Here each
group is cut into runs of `block` consecutive positions; the window works inside a
run, one summary row per run is scanned instead of the group, and the carry from the
earlier runs is joined back on (keys, run).  The position column must be an integer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 50_000


def _with_run(df: DataFrame, order: str, block: int) -> DataFrame:
    return df.withColumn("_run", F.floor(F.col(order) / F.lit(block)))


def carry_forward(
    df: DataFrame, keys: Sequence[str], order: str, values: dict[str, str], block: int = BLOCK
) -> DataFrame:
    """For each `values` item new -> old: the last non-null `old` at or above the row."""
    keys = list(keys)
    runs = _with_run(df, order, block)
    inside = Window.partitionBy(*keys, "_run").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = runs.withColumns({f"_l_{new}": F.last(old, True).over(inside) for new, old in values.items()})

    tails = runs.groupBy(*keys, "_run").agg(
        *[F.max_by(F.col(old), F.when(F.col(old).isNotNull(), F.col(order))).alias(f"_t_{new}")
          for new, old in values.items()]
    )
    before = Window.partitionBy(*keys).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    carry = tails.select(
        *keys, "_run", *[F.last(f"_t_{new}", True).over(before).alias(f"_c_{new}") for new in values]
    ).where(F.col("_run") > 0)
    out = local.join(carry, [*keys, "_run"], "left")
    return out.withColumns(
        {new: F.coalesce(f"_l_{new}", f"_c_{new}") for new in values}
    ).drop("_run", *[f"_l_{n}" for n in values], *[f"_c_{n}" for n in values])


def running_sum(
    df: DataFrame, keys: Sequence[str], order: str, values: dict[str, str], block: int = BLOCK
) -> DataFrame:
    """For each `values` item new -> old: the sum of `old` up to and including the row."""
    keys = list(keys)
    runs = _with_run(df, order, block)
    inside = Window.partitionBy(*keys, "_run").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = runs.withColumns({f"_l_{new}": F.sum(old).over(inside) for new, old in values.items()})
    totals = runs.groupBy(*keys, "_run").agg(*[F.sum(old).alias(f"_t_{new}") for new, old in values.items()])
    before = Window.partitionBy(*keys).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *keys, "_run", *[F.sum(f"_t_{new}").over(before).alias(f"_c_{new}") for new in values]
    ).where(F.col("_run") > 0)
    out = local.join(carry, [*keys, "_run"], "left")
    return out.withColumns(
        {new: F.coalesce(F.col(f"_l_{new}"), F.lit(0)) + F.coalesce(F.col(f"_c_{new}"), F.lit(0)) for new in values}
    ).drop("_run", *[f"_l_{n}" for n in values], *[f"_c_{n}" for n in values])


def next_value(df: DataFrame, keys: Sequence[str], order: str, values: dict[str, str]) -> DataFrame:
    """For each `values` item new -> old: `old` of the row at position + 1 (dense positions)."""
    shifted = df.select(*keys, (F.col(order) - 1).alias(order), *[F.col(o).alias(n) for n, o in values.items()])
    return df.join(shifted, [*keys, order], "left")

"""The metric panel: order lines rolled up to entity, group, segment, channel and fiscal period.

Money is added as whole BIGINT units of 1e-4 per order (exact, inside codegen) and as
DECIMAL above that, so results do not depend on the order of addition and cannot overflow.
Lines are collapsed per order before anything is joined; the join keys to the dimension
tables are left to Catalyst, which broadcasts a table only below its size threshold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.periods import fiscal_quarter, fiscal_year
from ..sources.tables import read_table

UNIT = 10_000


def report_periods(spark: SparkSession, sf_dir: str) -> list[tuple[int, int]]:
    """(fy, quarter) of all orders with lines: as many as the calendar has quarters, whatever the size of the tables."""
    return sorted((r.fy, r.q) for r in order_rows(spark, sf_dir, ["policies"]).select("fy", "q").distinct().collect())


def years(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    """First and last fiscal year of the orders."""
    found = [fy for fy, _ in report_periods(spark, sf_dir)]
    return min(found), max(found)


def complete_years(spark: SparkSession, sf_dir: str) -> list[int]:
    """Fiscal years of which the orders have all four quarters."""
    periods = report_periods(spark, sf_dir)
    return sorted({fy for fy, _ in periods if all((fy, q) in periods for q in (1, 2, 3, 4))})


def _cents() -> Column:
    return F.round(F.col("l_extendedprice") * 100).cast("bigint")


def _pct(name: str) -> Column:
    return F.round(F.col(name) * 100).cast("bigint")


def line_measures() -> dict[str, Column]:
    """Additive measures of one order line, in units of 1e-4."""
    price, disc, tax = _cents(), _pct("l_discount"), _pct("l_tax")
    qty = F.round(F.col("l_quantity")).cast("bigint") * UNIT
    net, returned = price * (100 - disc), F.col("l_returnflag")
    open_line = F.col("l_linestatus") == "O"
    return {
        "value": net,
        "gross": price * 100,
        "ceded": price * disc,
        "commission": price * tax,
        "accepted": F.when(returned == "A", price * disc).otherwise(0),
        "claims": F.when(returned == "R", net).otherwise(0),
        "earned": F.when(~open_line, net).otherwise(0),
        "opex": F.when(open_line, price * disc).otherwise(0),
        "manpower": F.when(returned == "N", price * tax).otherwise(0),
        "claims_reported": F.when(returned == "R", qty).otherwise(0),
        "claims_settled": F.when((returned == "R") & ~open_line, qty).otherwise(0),
        "quantity": qty,
    }


def sum_units(name: str) -> Column:
    """Exact sum of BIGINT units, as DOUBLE."""
    return (F.sum(F.col(name).cast("decimal(19,0)")).cast("double") / UNIT).alias(name)


def order_rows(spark: SparkSession, sf_dir: str, measures: Sequence[str]) -> DataFrame:
    """One row per order that has lines: the lines added up, with customer, channel and fiscal period."""
    orders = read_table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("okey"),
        F.col("o_custkey").alias("custkey"),
        F.col("o_orderpriority").alias("channel"),
        fiscal_year("o_orderdate").alias("fy"),
        fiscal_quarter("o_orderdate").alias("q"),
    )
    wanted = [m for m in measures if m != "policies"]
    if wanted:
        exprs = line_measures()
        lines = (
            read_table(spark, sf_dir, "lineitem")
            .select(F.col("l_orderkey").alias("okey"), *[exprs[m].alias(m) for m in wanted])
            .groupBy("okey")
            .agg(*[F.sum(m).alias(m) for m in wanted])
        )
        orders = orders.join(lines, "okey")
    else:
        orders = orders.join(
            read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("okey")), "okey", "left_semi"
        )
    return orders.withColumn("policies", F.lit(UNIT).cast("bigint"))


def with_entity(spark: SparkSession, sf_dir: str, orders: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds the customer-side dimensions that `keys` needs, and only those."""
    if not {"entity", "grp", "segment", "nationkey"} & set(keys):
        return orders
    out = orders.join(
        read_table(spark, sf_dir, "customer").select(
            F.col("c_custkey").alias("custkey"), F.col("c_nationkey").alias("nationkey"),
            F.col("c_mktsegment").alias("segment"),
        ),
        "custkey",
    )
    if {"entity", "grp"} & set(keys):
        out = out.join(entities(spark, sf_dir), "nationkey")
    return out


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity, group: one row per nation."""
    nation = read_table(spark, sf_dir, "nation")
    region = read_table(spark, sf_dir, "region")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").alias("nationkey"), F.col("n_name").alias("entity"), F.col("r_name").alias("grp")
    )


def panel(spark: SparkSession, sf_dir: str, keys: Sequence[str], measures: Sequence[str] = ("value",)) -> DataFrame:
    """keys + measures; keys from entity, grp, segment, channel, fy, q."""
    rows = with_entity(spark, sf_dir, order_rows(spark, sf_dir, measures), keys)
    return rows.groupBy(*keys).agg(*[sum_units(m) for m in measures])


def pair_periods(df: DataFrame, keys: Sequence[str], measures: Sequence[str], fy: str = "fy") -> DataFrame:
    """Each measure m becomes m (this year) and m_prior (same period, one year earlier).

    Every row is offered to its own year and to the next one and the two are met in one
    grouping: one pass over the input, no self-join, and gaps in the years stay gaps. Rows of
    one key and year add up.
    """
    offered = df.withColumn("_shift", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn(fy, F.col(fy) + F.col("_shift"))
    return (
        offered.groupBy(*keys, fy)
        .agg(
            *[F.sum(F.when(F.col("_shift") == 0, F.col(m))).alias(m) for m in measures],
            *[F.sum(F.when(F.col("_shift") == 1, F.col(m))).alias(f"{m}_prior") for m in measures],
            F.min("_shift").alias("_first"),
        )
        .where(F.col("_first") == 0)
        .drop("_first")
    )


def paired_panel(
    spark: SparkSession, sf_dir: str, keys: Sequence[str], measures: Sequence[str] = ("value",)
) -> DataFrame:
    """panel + pair_periods, for keys that hold fy."""
    rest = [k for k in keys if k != "fy"]
    return pair_periods(panel(spark, sf_dir, keys, measures), rest, measures)

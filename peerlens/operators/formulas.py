"""Derived metrics as one formula table, evaluated in a single projection over a wide row.

A wide row holds one entity and period: input `x` is the current figure, `x_prior` the same
period one year earlier.  Inputs a table does not have count as missing.  Ratios are null on a
missing or zero denominator and carry four decimals unless the formula says otherwise.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import base_plus, convert_units, ratio, sum_available
from ..functions.periods import months_elapsed
from .series import opening_closing_average

Getter = Callable[[str], Column]


def _money(c: Column) -> Column:
    """Sums that are rounded afterwards are added as decimals: a half must be a half."""
    return c.cast("decimal(24,4)")


def gross_written(v: Getter) -> Column:
    return base_plus(v("direct_premium"), v("accepted_premium"))


def investment_income(v: Getter) -> Column:
    return sum_available(*[v(f"investment_income_{i}") for i in range(1, 7)])


def overheads(v: Getter) -> Column:
    """Commission and operating expenses are required; provisions and other income are not."""
    provisions = F.coalesce(v("provisions_total") - F.coalesce(v("contribution"), F.lit(0.0)), F.lit(0.0))
    return v("net_commission") + v("opex") + provisions - F.coalesce(v("other_income"), F.lit(0.0))


def expense_ratio(v: Getter) -> Column:
    return ratio(sum_available(v("net_commission"), v("opex")), v("nwp"))


def loss_ratio(v: Getter) -> Column:
    return ratio(v("claims"), v("earned"))


def management_ratio(v: Getter) -> Column:
    spent = sum_available(v("gross_commission"), v("accepted_commission"), v("opex"))
    return ratio(spent - F.coalesce(v("gst"), F.lit(0.0)) - F.coalesce(v("ceo_pay"), F.lit(0.0)), v("gwp"))


def manpower(v: Getter) -> Column:
    """Staff cost without half of the in-house claims handling, which forms print with either sign."""
    part = _money(F.abs(F.nullif(v("in_house_claims"), F.lit(0.0))))
    return F.coalesce(F.round(_money(v("manpower")) - F.lit(Decimal("0.5")) * part, 2).cast("double"), v("manpower"))


def net_worth(v: Getter) -> Column:
    total = _money(v("capital")) + _money(v("reserves")) - F.coalesce(_money(v("debit_balance")), F.lit(0))
    return F.round(total, 2).cast("double")


def cost_per_employee(v: Getter) -> Column:
    staff = F.coalesce(
        (F.nullif(v("opening_employees"), F.lit(0.0)) + F.nullif(v("employees"), F.lit(0.0))) / 2, v("employees"))
    return F.round(F.try_divide(manpower(v) * 100, staff), 4)


def rental_per_office(v: Getter, months: Column) -> Column:
    offices = F.coalesce(opening_closing_average(v("opening_offices"), v("closing_offices")), v("offices"))
    return F.round(F.try_divide(_money(v("rent")) * 100, (months * offices).cast("decimal(20,2)")), 4).cast("double")


def return_on_equity(c: Getter, p: Getter) -> Column:
    return F.round(F.try_divide(c("pat"), F.nullif((net_worth(c) + net_worth(p)) / 2, F.lit(0.0))), 4)


def settlement_ratio(v: Getter) -> Column:
    open_claims = v("claims_os_start") + v("claims_reported") - F.coalesce(v("claims_os_end"), F.lit(0.0))
    return ratio(v("claims_settled"), open_claims)


def underwriting_profit(v: Getter) -> Column:
    return v("earned") - v("claims") - v("net_commission") - v("opex")


def plain_ratio(a: Column, b: Column) -> Column:
    """Segment accounts keep unrounded ratios."""
    return ratio(a, b, None)


@dataclass(frozen=True)
class Metric:
    slide: int
    metric1: str
    metric2: str | None
    value: Callable[[Getter], Column]
    current_only: bool = False


COMPANY_METRICS = [
    Metric(18, "Gross Written Premium", None, gross_written),
    Metric(18, "Investment Income", None, investment_income),
    Metric(18, "Total Overheads", None, overheads),
    Metric(22, "Expense Ratio", None, expense_ratio),
    Metric(22, "Loss Ratio", None, loss_ratio),
    Metric(22, "Combined Ratio", None, lambda v: expense_ratio(v) + loss_ratio(v)),
    Metric(33, "Expense of Management Ratio", None, management_ratio),
    Metric(24, "Opex. To GWP ratio", None, lambda v: ratio(v("opex"), v("gwp"))),
    Metric(24, "Manpower to GWP ratio", None, lambda v: ratio(manpower(v), v("gwp"))),
    Metric(24, "IT spend to GWP ratio", None, lambda v: ratio(v("it_capex"), v("gwp")), True),
    Metric(25, "Manpower cost to total Opex", None, lambda v: ratio(manpower(v), v("opex"))),
    Metric(25, "Manpower cost per employee", None, cost_per_employee, True),
    Metric(25, "Facility rental per office per month", None, lambda v: rental_per_office(v, months_elapsed(F.col("q"))), True),
    Metric(26, "Net Worth", None, lambda v: F.round(net_worth(v) * 100, 2)),
    Metric(26, "Capital", None, lambda v: v("cumulative_capital")),
    Metric(26, "PBT", None, lambda v: v("pbt")),
    Metric(31, "PBT", None, lambda v: v("pbt")),
    Metric(31, "GWP", None, lambda v: v("gwp")),
    Metric(34, "RI Ceding to GWP Ratio", "Risk Ceded", lambda v: ratio(v("ri_ceded"), v("gwp")), True),
    Metric(34, "RI Commission to RI Ceding", "Risk Ceded", lambda v: ratio(v("ri_commission"), v("ri_ceded")), True),
    Metric(15, "Individual ATS", None,
           lambda v: F.round(F.try_divide(F.nullif(v("channel_premium"), F.lit(0.0)) * 1e7, v("channel_policies")), 2)),
    Metric(15, "Average Productivity (per agent)", None,
           lambda v: F.round(F.try_divide(v("channel_premium") * 100, v("agents")), 4), True),
    Metric(23, "Claims Settlement Ratio", None, settlement_ratio, True),
    Metric(23, "No. of claims to No. of policies", None,
           lambda v: F.round(F.try_divide(v("claims_count"), F.coalesce(F.nullif(v("policies_printed"), F.lit(0.0)), v("policies"))), 6), True),
    Metric(27, "Claim Settlement Ratio (Amount)", None,
           lambda v: ratio(v("amount_settled"), v("amount_start") + v("amount_reported") - F.coalesce(v("amount_end"), F.lit(0.0))), True),
    Metric(27, "Claim Complaints per 10,000 claims", None, lambda v: v("claim_complaints"), True),
    Metric(27, "Policy Complaints per 10,000 policies", None, lambda v: v("policy_complaints"), True),
    Metric(23, "Average Claim Size", None,
           lambda v: F.round(F.try_divide(v("claims_paid_lakh") * 1e5, v("claims_paid_count")), 2), True),
]

SEGMENT_METRICS = [
    Metric(19, "UW Profit/(Loss)", None, underwriting_profit),
    Metric(19, "Loss Ratio", None, lambda v: plain_ratio(v("claims"), v("earned"))),
    Metric(19, "Expense Ratio", None, lambda v: plain_ratio(v("net_commission") + v("opex"), v("nwp"))),
    Metric(19, "Combined Ratio", None,
           lambda v: plain_ratio(v("claims"), v("earned")) + plain_ratio(v("net_commission") + v("opex"), v("nwp"))),
]


def _getter(df: DataFrame, suffix: str) -> Getter:
    have = set(df.columns)
    return lambda name: F.col(name + suffix) if name + suffix in have else F.lit(None).cast("double")


def evaluate(df: DataFrame, keys: Sequence[str], metrics: Sequence[Metric], only: set[str] | None = None) -> DataFrame:
    """keys + (slide, metric1, metric2, cur, prior), one row per metric of each wide row."""
    cur, prior = _getter(df, ""), _getter(df, "_prior")
    rows = [
        F.struct(
            F.lit(m.slide).alias("slide"),
            F.lit(m.metric1).alias("metric1"),
            F.lit(m.metric2).cast("string").alias("metric2"),
            m.value(cur).cast("double").alias("cur"),
            (F.lit(None) if m.current_only else m.value(prior)).cast("double").alias("prior"),
        )
        for m in metrics
        if only is None or m.metric1 in only
    ]
    return df.select(*keys, F.inline(F.array(*rows)))


def with_return_on_equity(df: DataFrame) -> Column:
    return return_on_equity(_getter(df, ""), _getter(df, "_prior"))


def signed_cession(gross: Column, ceded: Column, net: Column) -> Column:
    """Brackets on a ceded line: a deduction or a reversal, whichever reproduces the printed net."""
    as_deduction = F.abs(gross + ceded - net) < F.abs(gross - ceded - net)
    return F.when(gross.isNull() | net.isNull(), ceded).when(as_deduction, -ceded).otherwise(ceded)


def to_targets(values: DataFrame, targets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, slide, metric1, metric2, cur, prior: each figure in every row of the report that shows it, in its unit.

    values: keys, key, kind, cur, prior; targets: key, slide, metric1, metric2.  A figure without a target is left out.
    """
    unit = lambda c: convert_units(F.col(c), F.col("kind")).alias(c)
    return values.join(targets, "key").select(*keys, "slide", "metric1", "metric2", unit("cur"), unit("prior"))

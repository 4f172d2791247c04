"""Rollup, mix, pivot and derived-metric queries over the panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed_values as fixed
from ..functions.numbers import base_plus, ratio, sum_available
from ..operators import formulas, rollup, series
from ..sources.tables import read_table
from .fact_table import ROWS_SQL, metric_rows
from .panel import UNIT, fiscal_quarter, fiscal_year, pair_periods, paired_panel, panel
from .registry import FACTS, paired_sql, panel_sql, query

D = "CAST(SUM(CAST({0} AS DECIMAL(38,4))) AS DOUBLE)"
STATE_OWNED = ["NATION_0", "NATION_6", "NATION_12", "NATION_18"]
OWNED_SQL = "('NATION_0', 'NATION_6', 'NATION_12', 'NATION_18')"
NAMED = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"]
NAMED_SQL = "('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED')"


@query("group_total", panel_sql("entity, fy, q") +
       f" SELECT fy, q, CAST(SUM(CAST(CASE WHEN entity IN {OWNED_SQL} THEN value ELSE 0 END AS DECIMAL(38,4))) AS DOUBLE) AS total"
       " FROM panel GROUP BY fy, q")
def group_total(spark, sf_dir):
    p = panel(spark, sf_dir, ["entity", "fy", "q"])
    return rollup.group_total(p, ["fy", "q"], F.col("entity").isin(*STATE_OWNED), "value")


@query("residual", panel_sql("entity, segment, fy, q") + f"""
SELECT segment, fy, q,
  CAST(SUM(CAST(CASE WHEN entity IN {OWNED_SQL} THEN value ELSE 0 END AS DECIMAL(38,4))) AS DOUBLE) AS members,
  CAST(SUM(CAST(CASE WHEN entity IN {OWNED_SQL} THEN 0 ELSE value END AS DECIMAL(38,4))) AS DOUBLE) AS residual,
  {D.format('value')} AS subtotal FROM panel GROUP BY segment, fy, q""")
def residual(spark, sf_dir):
    p = panel(spark, sf_dir, ["entity", "segment", "fy", "q"])
    return rollup.subtotal_residual(p, ["segment", "fy", "q"], F.col("entity").isin(*STATE_OWNED), "value")


@query("others_residual", panel_sql("entity, channel, fy, q") + f"""
SELECT entity, fy, q, {D.format('value')} AS total,
  CASE WHEN COUNT(DISTINCT channel) FILTER (channel IN {NAMED_SQL}) = 4 THEN
    CAST(round(SUM(CAST(value AS DECIMAL(38,4))) - SUM(CAST(value AS DECIMAL(38,4))) FILTER (channel IN {NAMED_SQL}), 2) AS DOUBLE)
  END AS others
FROM panel GROUP BY entity, fy, q""")
def others_residual(spark, sf_dir):
    p = panel(spark, sf_dir, ["entity", "channel", "fy", "q"])
    return rollup.others_residual(p, ["entity", "fy", "q"], "channel", NAMED, "value")


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
PIVOT = ", ".join(f"max(value) FILTER (segment = '{s}') AS {s.lower()}" for s in SEGMENTS)


def segment_columns(spark, sf_dir):
    p = panel(spark, sf_dir, ["entity", "segment", "fy", "q"])
    return rollup.pivot_last(p, ["entity", "fy", "q"], "segment", SEGMENTS, "value", "value")


@query("pivot_metric", panel_sql("entity, segment, fy, q") + f" SELECT entity, fy, q, {PIVOT} FROM panel GROUP BY entity, fy, q")
def pivot_metric(spark, sf_dir):
    return segment_columns(spark, sf_dir)


@query("null_degrading_sum", panel_sql("entity, segment, fy, q") + f"""
, wide AS (SELECT entity, fy, q, {PIVOT} FROM panel GROUP BY entity, fy, q)
SELECT entity, fy, q, CASE WHEN coalesce(automobile, building, furniture) IS NOT NULL
  THEN 0.0::DOUBLE + coalesce(automobile, 0) + coalesce(building, 0) + coalesce(furniture, 0) END AS total FROM wide""")
def null_degrading_sum(spark, sf_dir):
    wide = segment_columns(spark, sf_dir)
    return wide.select("entity", "fy", "q", sum_available(F.col("automobile"), F.col("building"), F.col("furniture")).alias("total"))


@query("optional_addends", panel_sql("entity, segment, fy, q") + f"""
, wide AS (SELECT entity, fy, q, {PIVOT} FROM panel GROUP BY entity, fy, q)
SELECT entity, fy, q, household + coalesce(machinery, 0) AS total FROM wide""")
def optional_addends(spark, sf_dir):
    wide = segment_columns(spark, sf_dir)
    return wide.select("entity", "fy", "q", base_plus(F.col("household"), F.col("machinery")).alias("total"))


MIX = "CASE WHEN t = 0 AND value = 0 THEN 0 ELSE round(value / nullif(t, 0), 4) END"


@query("segment_mix", panel_sql("entity, segment, fy, q") + f"""
, t AS (SELECT entity, fy, q, {D.format('value')} AS t FROM panel GROUP BY entity, fy, q)
SELECT entity, segment, fy, q, value, {MIX} AS share FROM panel JOIN t USING (entity, fy, q)""")
def segment_mix(spark, sf_dir):
    return rollup.mix_share(panel(spark, sf_dir, ["entity", "segment", "fy", "q"]), ["entity", "fy", "q"], "value")


@query("group_mix_mixed_convention", panel_sql("grp, segment, fy, q") + f"""
, t AS (SELECT grp, fy, q, {D.format('value')} AS t FROM panel GROUP BY grp, fy, q)
SELECT grp, segment, fy, q, value, CASE WHEN grp = 'ASIA' THEN {MIX} ELSE value END AS figure
FROM panel JOIN t USING (grp, fy, q)""")
def group_mix_mixed_convention(spark, sf_dir):
    p = panel(spark, sf_dir, ["grp", "segment", "fy", "q"])
    return rollup.mixed_convention(p, ["grp", "fy", "q"], "value", F.col("grp") == "ASIA")


@query("row_fractions", panel_sql("entity, segment, fy, q") + f"""
, t AS (SELECT entity, fy, q, {D.format('value')} AS t FROM panel GROUP BY entity, fy, q)
SELECT entity, segment, fy, q, value, CASE WHEN t = 0 AND value = 0 THEN 0 ELSE value / nullif(t, 0) END AS fraction
FROM panel JOIN t USING (entity, fy, q)""")
def row_fractions(spark, sf_dir):
    p = panel(spark, sf_dir, ["entity", "segment", "fy", "q"])
    return rollup.mix_share(p, ["entity", "fy", "q"], "value", "fraction", None)


# states in the order of their numbers; the last name belongs to no zone
STATES = [*fixed.ZONE_OF_STATE, "Offshore"]
# fixed values: state and zone, written out once more so that the table above is checked and not repeated
EXPECTED_ZONES = [
    ("Delhi", "North"), ("Uttar Pradesh", "North"), ("Haryana", "North"), ("Punjab", "North"), ("Rajasthan", "North"),
    ("Uttarakhand", "North"), ("Chandigarh", "North"), ("Himachal Pradesh", "North"), ("Jammu & Kashmir", "North"), ("Ladakh", "North"),
    ("Karnataka", "South"), ("Tamil Nadu", "South"), ("Kerala", "South"), ("Puducherry", "South"),
    ("Andaman and Nicobar Islands", "South"), ("Lakshadweep", "South"),
    ("West Bengal", "East"), ("Bihar", "East"), ("Jharkhand", "East"), ("Assam", "East"), ("Tripura", "East"), ("Manipur", "East"),
    ("Meghalaya", "East"), ("Arunachal Pradesh", "East"), ("Nagaland", "East"), ("Sikkim", "East"), ("Mizoram", "East"),
    ("Maharashtra", "West"), ("Gujarat", "West"), ("Goa", "West"), ("Daman & Diu", "West"), ("Dadra and Nagar Haveli", "West"),
    ("Telangana", "Central"), ("Madhya Pradesh", "Central"), ("Andhra Pradesh", "Central"), ("Odisha", "Central"),
    ("Chhattisgarh", "Central"),
]
STATE_NO = "CASE WHEN segment IN ('BUILDING', 'MACHINERY') THEN nationkey + 13 ELSE nationkey END"
STATE_SQL = (
    ", states(state_no, state) AS (VALUES " + ", ".join(f"({i}, '{s}')" for i, s in enumerate(STATES)) + ")"
    ", zones(state, zone) AS (VALUES " + ", ".join(f"('{s}', '{z}')" for s, z in EXPECTED_ZONES) + ")")
IN_STATE = f"LEFT JOIN states ON state_no = {STATE_NO} LEFT JOIN zones USING (state)"


def with_state(df):
    """The state of a row: its nation's number, moved on for two of the segments so that all states are reached."""
    number = F.when(F.col("segment").isin("BUILDING", "MACHINERY"), F.col("nationkey") + 13).otherwise(F.col("nationkey"))
    return df.withColumn("state", F.get(F.array(*[F.lit(s) for s in STATES]), number))


def by_state(spark, sf_dir, measures=("value",)):
    """Figures per business segment and state."""
    return with_state(panel(spark, sf_dir, ["segment", "nationkey", "fy", "q"], measures))


def zone_dimension(spark):
    return spark.createDataFrame(list(fixed.ZONE_OF_STATE.items()), "state string, zone string")


@query("zone_share", panel_sql("segment, nationkey, fy, q", "value, gross") + STATE_SQL + f"""
, z AS (SELECT segment, fy, q, coalesce(zone, 'Others (unclassified)') AS zone, {D.format('value')} AS value
        FROM panel {IN_STATE} GROUP BY ALL)
, b AS (SELECT segment, fy, q, {D.format('gross')} AS gross FROM panel GROUP BY ALL)
SELECT segment, fy, q, zone, value, gross, round(value / nullif(gross, 0), 4) AS share FROM z JOIN b USING (segment, fy, q)""")
def zone_share(spark, sf_dir):
    p = by_state(spark, sf_dir, ["value", "gross"])
    base = p.groupBy("segment", "fy", "q").agg(series.exact_sum(F.col("gross")).alias("gross"))
    zoned = rollup.classify(p, zone_dimension(spark), "state", "zone")
    return rollup.share_of_base(zoned, base, ["segment", "fy", "q"], "zone", "value", "gross")


@query("state_share_others", panel_sql("segment, nationkey, fy, q", "value, gross") + STATE_SQL + f"""
, z AS (SELECT segment, fy, q, CASE WHEN state IN ({', '.join(f"'{s}'" for s in fixed.NAMED_STATES)}) THEN state ELSE 'Others' END AS state,
        {D.format('value')} AS value FROM panel {IN_STATE} GROUP BY ALL)
, b AS (SELECT segment, fy, q, {D.format('gross')} AS gross FROM panel GROUP BY ALL)
SELECT segment, fy, q, state, value, gross, round(value / nullif(gross, 0), 4) AS share FROM z JOIN b USING (segment, fy, q)""")
def state_share_others(spark, sf_dir):
    p = by_state(spark, sf_dir, ["value", "gross"])
    base = p.groupBy("segment", "fy", "q").agg(series.exact_sum(F.col("gross")).alias("gross"))
    named = p.withColumn("state", rollup.named_or_others(F.col("state"), fixed.NAMED_STATES))
    return rollup.share_of_base(named, base, ["segment", "fy", "q"], "state", "value", "gross")


@query("channel_share", paired_sql("entity, channel, q") + f"""
, t AS (SELECT entity, fy, q, {D.format('value')} AS t, {D.format('value_prior')} AS tp FROM pairs GROUP BY ALL)
SELECT entity, fy, q, CASE WHEN channel IN {NAMED_SQL} THEN channel ELSE 'Others' END AS bucket,
  round(value / nullif(t, 0), 4) AS share, round(value_prior / nullif(tp, 0), 4) AS share_prior
FROM pairs JOIN t USING (entity, fy, q)""")
def channel_share(spark, sf_dir):
    p = paired_panel(spark, sf_dir, ["entity", "channel", "q", "fy"])
    p = p.withColumn("bucket", rollup.named_or_others(F.col("channel"), NAMED))
    both = p.groupBy("entity", "fy", "q", "bucket").agg(
        series.exact_sum(F.col("value")).alias("value"), series.exact_sum(F.col("value_prior")).alias("value_prior"))
    out = series.with_totals(both, ["entity", "fy", "q"], {"_t": "value", "_tp": "value_prior"})
    return out.select(
        "entity", "fy", "q", "bucket", ratio(F.col("value"), F.col("_t")).alias("share"),
        ratio(F.col("value_prior"), F.col("_tp")).alias("share_prior"))


@query("coarse_channel", panel_sql("entity, channel, fy, q") + f"""
SELECT entity, fy, q, CASE channel WHEN '1-URGENT' THEN 'Agents' WHEN '2-HIGH' THEN 'Brokers' ELSE 'Others' END AS bucket,
  CAST(round(SUM(CAST(value AS DECIMAL(38,4))), 2) AS DOUBLE) AS value FROM panel GROUP BY ALL""")
def coarse_channel(spark, sf_dir):
    p = panel(spark, sf_dir, ["entity", "channel", "fy", "q"])
    bucket = rollup.relabel(F.col("channel"), {"Agents": ["1-URGENT"], "Brokers": ["2-HIGH"]}, F.lit("Others"))
    total = F.round(F.sum(F.col("value").cast(series.MONEY)), 2).cast("double")
    return p.groupBy("entity", "fy", "q", bucket.alias("bucket")).agg(total.alias("value"))


@query("rollup_totals", panel_sql("grp, entity, segment, fy") + f"""
SELECT CASE WHEN GROUPING(grp) = 1 THEN 'All' ELSE grp END AS grp, CASE WHEN GROUPING(entity) = 1 THEN 'All' ELSE entity END AS entity,
  CASE WHEN GROUPING(segment) = 1 THEN 'All' ELSE segment END AS segment,
  CASE WHEN GROUPING(fy) = 1 THEN 'All' ELSE CAST(fy AS VARCHAR) END AS fy, {D.format('value')} AS value
FROM panel GROUP BY ROLLUP (fy, grp, entity, segment)""")
def rollup_totals(spark, sf_dir):
    return rollup.rolled_up(panel(spark, sf_dir, ["grp", "entity", "segment", "fy"]), ["fy", "grp", "entity", "segment"], ["value"])


@query("industry_row", panel_sql("entity, segment, fy, q") + f"""
SELECT fy, q, segment, CASE WHEN GROUPING(entity) = 1 THEN 'Industry' ELSE entity END AS entity, {D.format('value')} AS value
FROM panel GROUP BY GROUPING SETS ((fy, q, segment, entity), (fy, q, segment))""")
def industry_row(spark, sf_dir):
    return rollup.with_all_row(panel(spark, sf_dir, ["entity", "segment", "fy", "q"]), ["fy", "q", "segment"], "entity", ["value"])


LOB = {"Motor": ["AUTOMOBILE"], "Fire & Engineering": ["BUILDING", "MACHINERY"], "Others": ["FURNITURE", "HOUSEHOLD"]}


@query("lob_groups", panel_sql("segment, fy, q") + f"""
SELECT fy, q, CASE WHEN segment = 'AUTOMOBILE' THEN 'Motor' WHEN segment IN ('BUILDING', 'MACHINERY') THEN 'Fire & Engineering'
  ELSE 'Others' END AS lob, {D.format('value')} AS total FROM panel GROUP BY ALL""")
def lob_groups(spark, sf_dir):
    p = panel(spark, sf_dir, ["segment", "fy", "q"])
    return rollup.available_total(p.withColumn("lob", rollup.relabel(F.col("segment"), LOB)), ["fy", "q", "lob"], "value")


@query("metric_series", f"WITH {FACTS} {ROWS_SQL}" + """
SELECT company, nationkey AS place, fy, q, cur, prior FROM mrows JOIN (SELECT DISTINCT entity, nationkey FROM facts) ON company = entity
WHERE metric1 = 'Revenue Growth'""")
def metric_series(spark, sf_dir):
    rows = metric_rows(spark, sf_dir).withColumn("row_no", F.col("slide"))
    order = read_table(spark, sf_dir, "nation").select(F.col("n_name").alias("company"), F.col("n_nationkey").alias("place"))
    return rollup.metric_series(rows, order, "company", "Revenue Growth", None, ["fy", "q"])


@query("missing_audit", f"WITH {FACTS} {ROWS_SQL}" +
       " SELECT company, slide, count(*) AS missing FROM mrows WHERE cur IS NULL OR prior IS NULL GROUP BY ALL")
def missing_audit(spark, sf_dir):
    return rollup.missing_audit(metric_rows(spark, sf_dir), ["company", "slide"])


@query("outcome_counts", f"WITH {FACTS} {ROWS_SQL}" + """
SELECT slide, fy, count(*) FILTER (prior IS NOT NULL) AS found, count(*) FILTER (prior IS NULL) AS not_found FROM mrows GROUP BY ALL""")
def outcome_counts(spark, sf_dir):
    return metric_rows(spark, sf_dir).groupBy("slide", "fy").agg(
        F.count_if(F.col("prior").isNotNull()).alias("found"), F.count_if(F.col("prior").isNull()).alias("not_found"))


# ---- derived metrics -------------------------------------------------------------------

INPUTS = {
    "direct_premium": "gross", "accepted_premium": "accepted", "nwp": "value", "earned": "earned", "claims": "claims",
    "net_commission": "commission", "gross_commission": "commission", "opex": "opex", "manpower": "manpower",
    "ri_ceded": "ceded", "ri_commission": "accepted", "provisions_total": "ceded", "contribution": "manpower",
    "claims_reported": "claims_reported", "claims_settled": "claims_settled", "claims_count": "claims_reported",
    "policies": "policies", "gst": "manpower", "capital": "gross", "reserves": "value", "debit_balance": "claims",
    "pat": "opex", "pbt": "commission", "in_house_claims": "accepted", "claims_paid_lakh": "claims",
    "claims_paid_count": "claims_reported", "claims_os_start": "quantity", "it_capex": "manpower", "rent": "opex",
    "employees": "quantity", "opening_offices": "claims_settled", "closing_offices": "claims_reported",
    "investment_income_1": "commission", "investment_income_2": "accepted", "cumulative_capital": "gross",
    "channel_premium": "gross", "channel_policies": "policies", "amount_settled": "claims", "amount_start": "gross",
    "amount_reported": "value", "claim_complaints": "claims_settled", "policy_complaints": "claims_reported",
}
MEASURES = ["gross", "accepted", "value", "earned", "claims", "commission", "opex", "manpower", "ceded", "claims_reported",
            "claims_settled", "quantity", "policies"]


def wide_metrics(spark, sf_dir, keys):
    """Wide row per entity and period: the inputs of the formula table, this year and the year before."""
    pairs = paired_panel(spark, sf_dir, [*keys, "q", "fy"], MEASURES)
    pairs = pairs.withColumns({"gwp_in": F.col("gross") + F.coalesce("accepted", F.lit(0.0)),
                               "gwp_in_prior": F.col("gross_prior") + F.coalesce("accepted_prior", F.lit(0.0))})
    return pairs.select(
        *keys, "q", "fy",
        *[F.col(m).alias(n) for n, m in INPUTS.items()], *[F.col(f"{m}_prior").alias(f"{n}_prior") for n, m in INPUTS.items()],
        F.col("gwp_in").alias("gwp"), F.col("gwp_in_prior").alias("gwp_prior"),
    )


ALL_MEASURES = ", ".join(MEASURES)


def long_sql(keys: str, metrics: list[tuple[int, str, str | None, str, bool]]) -> str:
    """Long metric rows from `pairs`; `{m}` in an expression is the current or prior measure m."""
    parts = []
    for slide, m1, m2, expr, current_only in metrics:
        cur = expr.format(**{m: m for m in MEASURES})
        prior = "NULL" if current_only else expr.format(**{m: f"{m}_prior" for m in MEASURES})
        second = "NULL" if m2 is None else f"'{m2}'"
        parts.append(f"SELECT {keys}, fy, q, {slide} AS slide, '{m1}' AS metric1, CAST({second} AS VARCHAR) AS metric2, "
                     f"CAST({cur} AS DOUBLE) AS cur, CAST({prior} AS DOUBLE) AS prior FROM pairs")
    return paired_sql(f"{keys}, q", ALL_MEASURES) + "\n" + "\nUNION ALL\n".join(parts)


GWP = "({gross} + {accepted})"
MANPOWER = ("(CASE WHEN {accepted} <> 0 THEN CAST(round(CAST({manpower} AS DECIMAL(24,4)) - CAST(0.5 AS DECIMAL(2,1)) * CAST({accepted} AS DECIMAL(24,4)), 2)"
            " AS DOUBLE) ELSE {manpower} END)")
EXPENSE = "round(({commission} + {opex}) / nullif({value}, 0), 4)"
LOSS = "round({claims} / nullif({earned}, 0), 4)"
RATIOS = [
    (18, "Gross Written Premium", None, GWP, False),
    (18, "Investment Income", None, "({commission} + {accepted})", False),
    (18, "Total Overheads", None, "({commission} + {opex} + ({ceded} - {manpower}))", False),
    (22, "Expense Ratio", None, EXPENSE, False),
    (22, "Loss Ratio", None, LOSS, False),
    (22, "Combined Ratio", None, f"{EXPENSE} + {LOSS}", False),
    (33, "Expense of Management Ratio", None, f"round(({{commission}} + {{opex}} - {{manpower}}) / nullif({GWP}, 0), 4)", False),
    (24, "Opex. To GWP ratio", None, f"round({{opex}} / nullif({GWP}, 0), 4)", False),
    (24, "Manpower to GWP ratio", None, f"round({MANPOWER} / nullif({GWP}, 0), 4)", False),
    (24, "IT spend to GWP ratio", None, f"round({{manpower}} / nullif({GWP}, 0), 4)", True),
    (25, "Manpower cost to total Opex", None, f"round({MANPOWER} / nullif({{opex}}, 0), 4)", False),
    (34, "RI Ceding to GWP Ratio", "Risk Ceded", f"round({{ceded}} / nullif({GWP}, 0), 4)", True),
    (34, "RI Commission to RI Ceding", "Risk Ceded", "round({accepted} / nullif({ceded}, 0), 4)", True),
    (31, "GWP", None, GWP, False),
    (26, "PBT", None, "{commission}", False),
    (31, "PBT", None, "{commission}", False),
]


@query("ratio_table", long_sql("entity", RATIOS))
def ratio_table(spark, sf_dir):
    names = {m[1] for m in RATIOS}
    return formulas.evaluate(wide_metrics(spark, sf_dir, ["entity"]), ["entity", "fy", "q"], formulas.COMPANY_METRICS, names)


# whole-number rounding: twice the office count is whole, so is the rent in units of 1e-4
OFFICES_TWICE = ("CAST(CASE WHEN {claims_settled} <> 0 AND {claims_reported} <> 0 THEN {claims_settled} + {claims_reported} "
                 "WHEN {claims_settled} <> 0 THEN 2 * {claims_settled} WHEN {claims_reported} <> 0 THEN 2 * {claims_reported} END * q * 3 AS HUGEINT)")
RENTAL = f"CAST((400 * CAST(round({{opex}} * 10000) AS HUGEINT) + {OFFICES_TWICE}) // (2 * {OFFICES_TWICE}) AS DOUBLE) / 10000"
PER_UNIT = [
    (25, "Manpower cost per employee", None, f"round({MANPOWER} * 100 / nullif({{quantity}}, 0), 4)", True),
    (25, "Facility rental per office per month", None, RENTAL, True),
    (15, "Individual ATS", None, "round(nullif({gross}, 0) * 1e7::DOUBLE / nullif({policies}, 0), 2)", False),
    (23, "No. of claims to No. of policies", None, "round({claims_reported} / nullif({policies}, 0), 6)", True),
    (23, "Average Claim Size", None, "round({claims} * 1e5::DOUBLE / nullif({claims_reported}, 0), 2)", True),
]


@query("per_unit_metrics", long_sql("entity", PER_UNIT))
def per_unit_metrics(spark, sf_dir):
    names = {m[1] for m in PER_UNIT}
    return formulas.evaluate(wide_metrics(spark, sf_dir, ["entity"]), ["entity", "fy", "q"], formulas.COMPANY_METRICS, names)


@query("settlement_ratio", long_sql("entity, segment", [
    (23, "Claims Settlement Ratio", None, "round({claims_settled} / nullif({quantity} + {claims_reported}, 0), 4)", True)]))
def settlement_ratio(spark, sf_dir):
    wide = wide_metrics(spark, sf_dir, ["entity", "segment"])
    return formulas.evaluate(wide, ["entity", "segment", "fy", "q"], formulas.COMPANY_METRICS, {"Claims Settlement Ratio"})


NW = ("CAST(round(CAST({gross} AS DECIMAL(24,4)) + CAST({value} AS DECIMAL(24,4)) - CAST({claims} AS DECIMAL(24,4)), 2) AS DOUBLE)")
NW_CUR, NW_PRIOR = NW.format(gross="gross", value="value", claims="claims"), NW.format(
    gross="gross_prior", value="value_prior", claims="claims_prior")


@query("net_worth_roe", paired_sql("entity, q", ALL_MEASURES) + f"""
SELECT entity, fy, q, round({NW_CUR} * 100, 2) AS net_worth, round({NW_PRIOR} * 100, 2) AS net_worth_prior,
  gross AS capital, round(opex / nullif(({NW_CUR} + {NW_PRIOR}) / 2, 0), 4) AS roe FROM pairs""")
def net_worth_roe(spark, sf_dir):
    wide = wide_metrics(spark, sf_dir, ["entity"])
    cur, prior = (lambda n: F.col(n)), (lambda n: F.col(n + "_prior"))
    return wide.select(
        "entity", "fy", "q", F.round(formulas.net_worth(cur) * 100, 2).alias("net_worth"),
        F.round(formulas.net_worth(prior) * 100, 2).alias("net_worth_prior"), F.col("cumulative_capital").alias("capital"),
        formulas.with_return_on_equity(wide).alias("roe"),
    )


@query("segment_pnl", long_sql("entity, segment", [
    (19, "UW Profit/(Loss)", None, "{earned} - {claims} - {commission} - {opex}", False),
    (19, "Loss Ratio", None, "{claims} / nullif({earned}, 0)", False),
    (19, "Expense Ratio", None, "({commission} + {opex}) / nullif({value}, 0)", False),
    (19, "Combined Ratio", None, "{claims} / nullif({earned}, 0) + ({commission} + {opex}) / nullif({value}, 0)", False)]))
def segment_pnl(spark, sf_dir):
    wide = wide_metrics(spark, sf_dir, ["entity", "segment"])
    return formulas.evaluate(wide, ["entity", "segment", "fy", "q"], formulas.SEGMENT_METRICS)


@query("channel_rate", paired_sql("entity, channel, q", "gross, commission") + """
SELECT entity, channel, fy, q, round(commission * 100, 2) AS commission_lakh, round(commission_prior * 100, 2) AS commission_lakh_prior,
  round(commission / nullif(gross, 0), 4) AS rate, round(commission_prior / nullif(gross_prior, 0), 4) AS rate_prior FROM pairs""")
def channel_rate(spark, sf_dir):
    # premium and commission come from different schedules and meet per entity and channel
    premium = panel(spark, sf_dir, ["entity", "channel", "fy", "q"], ["gross", "commission"])
    p = pair_periods(premium, ["entity", "channel", "q"], ["gross", "commission"])
    return p.select(
        "entity", "channel", "fy", "q",
        F.round(F.col("commission") * 100, 2).alias("commission_lakh"),
        F.round(F.col("commission_prior") * 100, 2).alias("commission_lakh_prior"),
        ratio(F.col("commission"), F.col("gross")).alias("rate"),
        ratio(F.col("commission_prior"), F.col("gross_prior")).alias("rate_prior"),
    )


@query("sign_choice", f"""WITH {FACTS}
, s AS (SELECT entity, segment, fy, q, CAST(SUM(gross) AS DOUBLE) AS gross,
   CASE WHEN q % 2 = 0 THEN -1 ELSE 1 END * CAST(SUM(ceded) AS DOUBLE) AS printed, CAST(SUM(value) AS DOUBLE) AS net FROM facts GROUP BY entity, segment, fy, q)
SELECT entity, segment, fy, q, printed, abs(printed) AS ceded FROM s""")
def sign_choice(spark, sf_dir):
    # even quarters print the deduction in brackets; the printed net decides what it means
    p = panel(spark, sf_dir, ["entity", "segment", "fy", "q"], ["gross", "ceded", "value"])
    printed = F.when(F.col("q") % 2 == 0, -F.col("ceded")).otherwise(F.col("ceded"))
    return p.select(
        "entity", "segment", "fy", "q", printed.alias("printed"),
        formulas.signed_cession(F.col("gross"), printed, F.col("value")).alias("ceded"))


@query("productivity_per_agent", f"""WITH {FACTS}
SELECT entity, fy, q, CAST(SUM(gross) AS DOUBLE) AS premium, COUNT(DISTINCT suppkey) AS agents,
  round(CAST(SUM(gross) AS DOUBLE) * 100 / COUNT(DISTINCT suppkey), 4) AS productivity FROM facts GROUP BY ALL""")
def productivity_per_agent(spark, sf_dir):
    from .panel import line_measures, with_entity

    lines = read_table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("okey"), F.col("l_suppkey").alias("suppkey"), line_measures()["gross"].alias("gross"))
    orders = read_table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("okey"), F.col("o_custkey").alias("custkey"),
        fiscal_year("o_orderdate").alias("fy"), fiscal_quarter("o_orderdate").alias("q"))
    rows = with_entity(spark, sf_dir, lines.join(orders, "okey"), ["entity"])
    # one row per agent first: the distinct count is then a plain count of small partial sums
    per_agent = rows.groupBy("entity", "fy", "q", "suppkey").agg(F.sum("gross").alias("gross"))
    return per_agent.groupBy("entity", "fy", "q").agg(
        (F.sum(F.col("gross").cast("decimal(19,0)")).cast("double") / UNIT).alias("premium"), F.count("*").alias("agents"),
    ).withColumn("productivity", F.round(F.try_divide(F.col("premium") * 100, F.col("agents")), 4))

"""Report tables rpt_03 ... rpt_40, each for every fiscal period of the data."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed_values as fixed
from ..functions.numbers import as_multiple, growth, ratio
from ..functions.periods import fiscal_quarter, fiscal_year
from ..operators import formulas, report, rollup, series
from ..sources.tables import read_table
from .panel import UNIT, complete_years, entities, line_measures, pair_periods, paired_panel, panel, report_periods
from .queries_rollup import ALL_MEASURES, EXPENSE, GWP, IN_STATE, LOB, LOSS, MANPOWER, NW, RENTAL, STATE_SQL, long_sql, wide_metrics, with_state, zone_dimension
from .registry import FACTS, paired_sql, panel_sql, query

D = "CAST(SUM(CAST({0} AS DECIMAL(38,4))) AS DOUBLE)"


# ---- stacked tables --------------------------------------------------------------------

def stacked_sql(base: str, category: str, series_name: str, shown: bool = False, label_from: float = 0.04) -> str:
    """base: SQL ending in a CTE `b` with fy, q, category, series, cur, prior."""
    extra = ", shown, shown_prior" if shown else ""
    join = f"LEFT JOIN shown s USING (fy, q, {category})" if shown else ""
    drop = "AND coalesce(shown, 1) <> 0" if shown else ""
    return base + f"""
, t AS (SELECT fy, q, {category}, {D.format('cur')} AS total, {D.format('prior')} AS total_prior FROM b GROUP BY fy, q, {category}
        HAVING bool_or(coalesce(cur, 0) <> 0 OR coalesce(prior, 0) <> 0))
SELECT fy, q, {category}, {series_name}, cur, prior, cur / nullif(total, 0) AS share, prior / nullif(total_prior, 0) AS share_prior, total, total_prior{extra},
  CASE WHEN total_prior > 0 THEN total / total_prior - 1 END AS growth, coalesce(cur / nullif(total, 0) >= {label_from}, false) AS labelled
FROM b JOIN t USING (fy, q, {category}) {join} WHERE true {drop}"""


def pair_base(keys: str, select: str, group: bool = False) -> str:
    """CTE b from the paired panel at `keys`; group when the select list aggregates."""
    return paired_sql(f"{keys}, q") + f", b AS (SELECT fy, q, {select}" + (
        f", {D.format('value')} AS cur, {D.format('value_prior')} AS prior FROM pairs GROUP BY ALL)" if group else
        ", value AS cur, value_prior AS prior FROM pairs)")


def pairs_at(spark, sf_dir, *keys):
    return paired_panel(spark, sf_dir, [*keys, "q", "fy"]).withColumnsRenamed({"value": "cur", "value_prior": "prior"})


def regrouped(df, keys):
    return df.groupBy("fy", "q", *keys).agg(series.exact_sum(F.col("cur")).alias("cur"), series.exact_sum(F.col("prior")).alias("prior"))


SHOWN_SQL = """, shown AS (SELECT fy, q, {0}, CAST(SUM(CAST(value AS DECIMAL(38,4))) AS DOUBLE) AS shown,
  CAST(SUM(CAST(value_prior AS DECIMAL(38,4))) AS DOUBLE) AS shown_prior FROM pairs GROUP BY fy, q, {0})"""


def shown_totals(df, category):
    """Display totals: the category's own figure, held beside the mix rows."""
    return df.groupBy("fy", "q", category).agg(
        series.exact_sum(F.col("cur")).alias("shown"), series.exact_sum(F.col("prior")).alias("shown_prior"))


@query("rpt_03_groups", stacked_sql(pair_base("grp", "'Industry' AS market, grp"), "market", "grp", label_from=0.03))
def rpt_03_groups(spark, sf_dir):
    df = pairs_at(spark, sf_dir, "grp").withColumn("market", F.lit("Industry"))
    return report.stacked(df, ["fy", "q"], "market", "grp", label_from=report.SLICE_LABEL_FROM)


LOB_CASE = "CASE WHEN segment = 'AUTOMOBILE' THEN 'Motor' WHEN segment IN ('BUILDING', 'MACHINERY') THEN 'Fire & Engineering' ELSE 'Others' END AS lob"


@query("rpt_03_lines", stacked_sql(pair_base("segment", f"'Industry' AS market, {LOB_CASE}", True), "market", "lob", label_from=0.03))
def rpt_03_lines(spark, sf_dir):
    df = pairs_at(spark, sf_dir, "segment").withColumns(
        {"market": F.lit("Industry"), "lob": rollup.relabel(F.col("segment"), LOB)})
    return report.stacked(regrouped(df, ["market", "lob"]), ["fy", "q"], "market", "lob", label_from=report.SLICE_LABEL_FROM)


@query("rpt_04", stacked_sql(pair_base("segment", "'Industry' AS market, segment"), "market", "segment", label_from=0.03))
def rpt_04(spark, sf_dir):
    df = pairs_at(spark, sf_dir, "segment").withColumn("market", F.lit("Industry"))
    return report.stacked(df, ["fy", "q"], "market", "segment", label_from=report.SLICE_LABEL_FROM)


@query("rpt_05", paired_sql("entity, q") + f"""
, t AS (SELECT fy, q, {D.format('value')} AS tc, {D.format('value_prior')} AS tp FROM pairs GROUP BY fy, q)
SELECT entity, fy, q, value AS cur, value_prior AS prior, (value / nullif(tc, 0) - value_prior / nullif(tp, 0)) * 100 AS share_points
FROM pairs JOIN t USING (fy, q) WHERE value_prior IS NOT NULL""")
def rpt_05(spark, sf_dir):
    df = series.year_on_year(pairs_at(spark, sf_dir, "entity"), ["fy", "q"], "cur", "prior")
    return df.where(F.col("prior").isNotNull()).select("entity", "fy", "q", "cur", "prior", F.col("share_change").alias("share_points"))


@query("rpt_06", stacked_sql(pair_base("segment, grp", "segment, grp"), "segment", "grp"))
def rpt_06(spark, sf_dir):
    return report.stacked(pairs_at(spark, sf_dir, "segment", "grp"), ["fy", "q"], "segment", "grp")


@query("rpt_07", stacked_sql(pair_base("segment, entity", "segment, entity"), "segment", "entity"))
def rpt_07(spark, sf_dir):
    return report.stacked(pairs_at(spark, sf_dir, "segment", "entity"), ["fy", "q"], "segment", "entity")


@query("rpt_08", paired_sql("entity, q") + f"""
, a AS (SELECT entity, fy, q, value AS cur, value_prior AS prior FROM pairs
  UNION ALL SELECT 'Industry', fy, q, {D.format('value')}, {D.format('value_prior')} FROM pairs GROUP BY fy, q)
SELECT *, round((cur - prior) / nullif(prior, 0), 4) AS growth, CASE WHEN prior > 0 THEN cur / prior - 1 END AS shown_growth FROM a""")
def rpt_08(spark, sf_dir):
    df = rollup.with_all_row(pairs_at(spark, sf_dir, "entity"), ["fy", "q"], "entity", ["cur", "prior"])
    shown = F.when(F.col("prior") > 0, F.try_divide(F.col("cur"), F.col("prior")) - 1)
    return df.select("entity", "fy", "q", "cur", "prior", growth(F.col("cur"), F.col("prior")).alias("growth"), shown.alias("shown_growth"))


@query("rpt_09", panel_sql("entity, fy") + f"""
, full_y AS (SELECT fy FROM (SELECT DISTINCT fy, q FROM facts) GROUP BY fy HAVING count(*) = 4)
, h AS (SELECT entity, fy + 1 AS fy_end, value FROM panel WHERE fy IN (SELECT fy FROM full_y)
  UNION ALL SELECT 'Industry', fy + 1, {D.format('value')} FROM panel WHERE fy IN (SELECT fy FROM full_y) GROUP BY fy)
, e AS (SELECT min(fy_end) AS a, max(fy_end) AS b FROM h)
SELECT x.entity, a AS first_year, b AS last_year, x.value AS first_value, y.value AS last_value, round(pow(y.value / x.value, 1.0 / (b - a)) - 1, 8) AS cagr
FROM e JOIN h x ON x.fy_end = a JOIN h y ON y.fy_end = b AND x.entity = y.entity WHERE x.value > 0""")
def rpt_09(spark, sf_dir):
    # complete years only: the data's first and last ones may have fewer than four quarters
    years = panel(spark, sf_dir, ["entity", "fy"]).where(F.col("fy").isin(complete_years(spark, sf_dir)))
    history = rollup.with_all_row(years, ["fy"], "entity", ["value"]).unpivot(["entity", "fy"], ["value"], "title", "value").select(
        "title", "entity", (F.col("fy") + 1).alias("fy_end"), "value")
    return series.cagr(history, "title", "entity", "fy_end", "value").drop("title")


@query("rpt_10", stacked_sql(pair_base("grp, segment", "grp, segment") + SHOWN_SQL.format("grp"), "grp", "segment", True))
def rpt_10(spark, sf_dir):
    df = pairs_at(spark, sf_dir, "grp", "segment")
    return report.stacked(df, ["fy", "q"], "grp", "segment", shown_totals(df, "grp"))


@query("rpt_11", stacked_sql(pair_base("entity, segment", "entity, segment") + SHOWN_SQL.format("entity"), "entity", "segment", True))
def rpt_11(spark, sf_dir):
    df = pairs_at(spark, sf_dir, "entity", "segment")
    return report.stacked(df, ["fy", "q"], "entity", "segment", shown_totals(df, "entity"))


@query("rpt_12", stacked_sql(pair_base("entity, channel", "entity, channel") + SHOWN_SQL.format("entity"), "entity", "channel", True))
def rpt_12(spark, sf_dir):
    df = pairs_at(spark, sf_dir, "entity", "channel")
    return report.stacked(df, ["fy", "q"], "entity", "channel", shown_totals(df, "entity"))


@query("rpt_13", paired_sql("entity, channel, q", "gross, commission") + f"""
, r AS (SELECT entity, channel, fy, q, round(commission / nullif(gross, 0), 4) AS rate, commission FROM pairs)
, t AS (SELECT entity, fy, q, {D.format('commission')} AS crore, CAST(SUM(CAST(rate AS DECIMAL(38,4))) FILTER (rate > 0) AS DOUBLE) AS rates FROM r GROUP BY entity, fy, q)
SELECT entity, channel, fy, q, rate, rate / rates AS height, crore FROM r JOIN t USING (entity, fy, q) WHERE rate > 0""")
def rpt_13(spark, sf_dir):
    p = panel(spark, sf_dir, ["entity", "channel", "fy", "q"], ["gross", "commission"])
    r = p.select("entity", "channel", "fy", "q", "commission", ratio(F.col("commission"), F.col("gross")).alias("rate"))
    positive = r.withColumn("_r", F.when(F.col("rate") > 0, F.col("rate")))
    t = series.with_totals(positive, ["entity", "fy", "q"], {"crore": "commission", "_t": "_r"})
    return t.where(F.col("rate") > 0).select(
        "entity", "channel", "fy", "q", "rate", F.try_divide(F.col("rate"), F.col("_t")).alias("height"), "crore")


GEO = paired_sql("segment, nationkey, q") + STATE_SQL


def by_states(spark, sf_dir):
    return with_state(pairs_at(spark, sf_dir, "segment", "nationkey"))


@query("rpt_16", stacked_sql(GEO + f", b AS (SELECT fy, q, segment, zone, {D.format('value')} AS cur, {D.format('value_prior')} AS prior"
       " FROM pairs " + IN_STATE + " WHERE zone IS NOT NULL GROUP BY ALL)" + SHOWN_SQL.format("segment"), "segment", "zone", True))
def rpt_16(spark, sf_dir):
    df = by_states(spark, sf_dir)
    zoned = rollup.classify(df, zone_dimension(spark), "state", "zone").where(F.col("zone") != "Others (unclassified)")
    return report.stacked(regrouped(zoned, ["segment", "zone"]), ["fy", "q"], "segment", "zone", shown_totals(df, "segment"))


@query("rpt_17", stacked_sql(GEO + f", b AS (SELECT fy, q, segment, CASE WHEN state IN ({', '.join(repr(s) for s in fixed.NAMED_STATES)}) THEN state ELSE 'Others' END AS state,"
       f" {D.format('value')} AS cur, {D.format('value_prior')} AS prior FROM pairs {IN_STATE} GROUP BY ALL)" + SHOWN_SQL.format("segment"), "segment", "state", True))
def rpt_17(spark, sf_dir):
    df = by_states(spark, sf_dir)
    named = df.withColumn("state", rollup.named_or_others(F.col("state"), fixed.NAMED_STATES))
    return report.stacked(regrouped(named, ["segment", "state"]), ["fy", "q"], "segment", "state", shown_totals(df, "segment"))


# portfolios: order lines by the supplier's nation and a property of the part or line
RATINGS = fixed.RATINGS
MATURITIES = fixed.MATURITIES
MATURITY_ENDS = [5, 15, 25, 40]
BUCKETS = list(fixed.CODE_BUCKETS)
BRANDS = [b for _, b in fixed.dimension_rows(fixed.CODE_BUCKETS)]


def portfolio(spark, sf_dir, bucket, of_line=False):
    """Figures by entity and bucket; bucket: of the part, or of the line (its partkey) where no part is needed."""
    lines = read_table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("okey"), F.col("l_suppkey").alias("suppkey"), F.col("l_partkey").alias("partkey"),
        line_measures()["value"].alias("v"))
    orders = read_table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("okey"), fiscal_year("o_orderdate").alias("fy"), fiscal_quarter("o_orderdate").alias("q"))
    if of_line:
        lines = lines.withColumn("bucket", bucket)
    else:
        lines = lines.join(read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("partkey"), bucket.alias("bucket")), "partkey")
    supplier = read_table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("suppkey"), F.col("s_nationkey").alias("nationkey"))
    rows = lines.join(orders, "okey").join(supplier, "suppkey").join(entities(spark, sf_dir), "nationkey")
    sums = rows.groupBy("entity", "bucket", "fy", "q").agg(
        (F.sum(F.col("v").cast("decimal(19,0)")).cast("double") / UNIT).alias("cur"))
    return pair_periods(sums, ["entity", "bucket", "q"], ["cur"]).withColumnRenamed("cur_prior", "prior")


def portfolio_sql(bucket: str) -> str:
    return f"""WITH p AS (SELECT n_name AS entity, {bucket} AS bucket, CAST(year(o_orderdate - INTERVAL 3 MONTH) AS INTEGER) AS fy,
   CAST(quarter(o_orderdate - INTERVAL 3 MONTH) AS INTEGER) AS q,
   CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2)) * (CAST(1 AS DECIMAL(4,2)) - CAST(l_discount AS DECIMAL(4,2)))) AS DOUBLE) AS cur
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL)
, b AS (SELECT a.entity, a.bucket, a.fy, a.q, a.cur, o.cur AS prior FROM p a LEFT JOIN p o ON a.entity = o.entity AND a.bucket = o.bucket AND a.q = o.q AND o.fy = a.fy - 1)"""


BRAND_NO = "CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INTEGER)"
MATURITY_SQL = "CASE " + " ".join(f"WHEN p_size <= {e} THEN '{m}'" for m, e in zip(MATURITIES, MATURITY_ENDS)) + f" ELSE '{MATURITIES[-1]}' END"


@query("rpt_28", stacked_sql(portfolio_sql(f"{BUCKETS!r}[{BRAND_NO} % 5 + 1]"), "entity", "bucket"))
def rpt_28(spark, sf_dir):
    number = F.regexp_extract("p_brand", "([0-9]+)", 1).cast("int")
    bucket = F.element_at(F.array(*[F.lit(b) for b in BUCKETS]), number % 5 + 1)
    return report.stacked(portfolio(spark, sf_dir, bucket), ["fy", "q"], "entity", "bucket")


@query("rpt_29", stacked_sql(portfolio_sql(f"{RATINGS!r}[CAST(p_partkey % 5 AS INTEGER) + 1]"), "entity", "bucket"))
def rpt_29(spark, sf_dir):
    bucket = F.element_at(F.array(*[F.lit(b) for b in RATINGS]), (F.col("partkey") % 5 + 1).cast("int"))
    return report.stacked(portfolio(spark, sf_dir, bucket, of_line=True), ["fy", "q"], "entity", "bucket")


@query("rpt_30", stacked_sql(portfolio_sql(MATURITY_SQL), "entity", "bucket"))
def rpt_30(spark, sf_dir):
    bucket = F.lit(MATURITIES[-1])
    for name, end in reversed(list(zip(MATURITIES, MATURITY_ENDS))):
        bucket = F.when(F.col("p_size") <= end, F.lit(name)).otherwise(bucket)
    return report.stacked(portfolio(spark, sf_dir, bucket), ["fy", "q"], "entity", "bucket")


# ---- statements ------------------------------------------------------------------------

def both(of):
    return of(lambda n: F.col(n)), of(lambda n: F.col(n + "_prior"))


STATEMENT = {
    "gwp": formulas.gross_written, "nwp": lambda v: v("nwp"), "earned": lambda v: v("earned"), "claims": lambda v: v("claims"),
    "pbt": lambda v: v("pbt"), "pat": lambda v: v("pat")}
STATEMENT_SQL = {"gwp": GWP, "nwp": "{value}", "earned": "{earned}", "claims": "{claims}", "pbt": "{commission}", "pat": "{opex}",
                 "investment_income": "({commission} + {accepted})", "overheads": "({commission} + {opex} + ({ceded} - {manpower}))"}
SEGMENT_SQL = {"gwp": GWP, "nwp": "{value}", "earned": "{earned}", "claims": "{claims}", "gross_commission": "{commission}", "ri_commission": "-{accepted}",
               "net_commission": "{commission}", "opex": "{opex}", "uw_profit": "({earned} - {claims} - {commission} - {opex})",
               "combined_ratio": "({claims} / nullif({earned}, 0) + ({commission} + {opex}) / nullif({value}, 0))",
               "loss_ratio": "{claims} / nullif({earned}, 0)", "expense_ratio": "({commission} + {opex}) / nullif({value}, 0)"}
MEASURE_NAMES = ALL_MEASURES.split(", ")


def statement_sql(keys: str, lines: dict[str, str], where: str = "") -> str:
    now = {m: m for m in MEASURE_NAMES}
    then = {m: f"{m}_prior" for m in MEASURE_NAMES}
    cols = [f"{e.format(**now)} AS {n}" for n, e in lines.items()] + [f"{e.format(**then)} AS {n}_prior" for n, e in lines.items()]
    return paired_sql(f"{keys}, q", ALL_MEASURES) + f" SELECT entity, fy, q, {', '.join(cols)} FROM pairs {where}"


@query("rpt_18", statement_sql("entity", STATEMENT_SQL))
def rpt_18(spark, sf_dir):
    lines = {n: both(f) for n, f in STATEMENT.items()}
    # only two of the six income lines are in the data
    lines["investment_income"] = both(lambda v: v("investment_income_1") + v("investment_income_2"))
    provisions = lambda v: F.coalesce(v("provisions_total") - F.coalesce(v("contribution"), F.lit(0.0)), F.lit(0.0))
    lines["overheads"] = both(lambda v: v("net_commission") + v("opex") + provisions(v))
    return report.statement(wide_metrics(spark, sf_dir, ["entity"]), ["entity", "fy", "q"], lines)


SEGMENT_LINES = {
    "gwp": formulas.gross_written, "nwp": lambda v: v("nwp"), "earned": lambda v: v("earned"), "claims": lambda v: v("claims"),
    "gross_commission": lambda v: v("gross_commission"), "ri_commission": lambda v: -v("ri_commission"),
    "net_commission": lambda v: v("net_commission"), "opex": lambda v: v("opex"), "uw_profit": formulas.underwriting_profit,
    "combined_ratio": lambda v: ratio(v("claims"), v("earned"), None) + ratio(v("net_commission") + v("opex"), v("nwp"), None),
    "loss_ratio": lambda v: ratio(v("claims"), v("earned"), None),
    "expense_ratio": lambda v: ratio(v("net_commission") + v("opex"), v("nwp"), None)}


def segment_statement(segment):
    def run(spark, sf_dir):
        wide = wide_metrics(spark, sf_dir, ["entity", "segment"]).where(F.col("segment") == segment)
        return report.statement(wide, ["entity", "fy", "q"], {n: both(f) for n, f in SEGMENT_LINES.items()})

    return run


for _number, _segment in ((19, "AUTOMOBILE"), (20, "BUILDING"), (21, "FURNITURE")):
    query(f"rpt_{_number}", statement_sql("entity, segment", SEGMENT_SQL, f"WHERE segment = '{_segment}'"))(segment_statement(_segment))


# ---- metric panels ---------------------------------------------------------------------

PANELS = {
    22: ([(22, "Combined Ratio", None, f"{EXPENSE} + {LOSS}", False), (22, "Expense Ratio", None, EXPENSE, False), (22, "Loss Ratio", None, LOSS, False)],
         {}, ["Combined Ratio", "Expense Ratio", "Loss Ratio"]),
    23: ([(23, "Claims Settlement Ratio", None, "round({claims_settled} / nullif({quantity} + {claims_reported}, 0), 4)", True),
          (23, "Average Claim Size", None, "round({claims} * 1e5::DOUBLE / nullif({claims_reported}, 0), 2)", True),
          (23, "No. of claims to No. of policies", None, "round({claims_reported} / nullif({policies}, 0), 6)", True)],
         {"Average Claim Size": 1e-5}, []),
    24: ([(24, "Opex. To GWP ratio", None, f"round({{opex}} / nullif({GWP}, 0), 4)", False), (24, "Manpower to GWP ratio", None, f"round({MANPOWER} / nullif({GWP}, 0), 4)", False),
          (24, "IT spend to GWP ratio", None, f"round({{manpower}} / nullif({GWP}, 0), 4)", True)], {}, ["Opex. To GWP ratio", "Manpower to GWP ratio"]),
    25: ([(25, "Manpower cost to total Opex", None, f"round({MANPOWER} / nullif({{opex}}, 0), 4)", False),
          (25, "Manpower cost per employee", None, f"round({MANPOWER} * 100 / nullif({{quantity}}, 0), 4)", True),
          (25, "Facility rental per office per month", None, RENTAL, True)], {}, []),
    26: ([(26, "Capital", None, "{gross}", False), (26, "Net Worth", None, f"round({NW} * 100, 2)", False), (26, "PBT", None, "{commission}", False)], {"Net Worth": 0.01}, []),
    27: ([(27, "Claim Settlement Ratio (Amount)", None, "round({claims} / nullif({gross} + {value}, 0), 4)", True),
          (27, "Claim Complaints per 10,000 claims", None, "{claims_settled}", True), (27, "Policy Complaints per 10,000 policies", None, "{claims_reported}", True)],
         {}, ["Claim Complaints per 10,000 claims", "Policy Complaints per 10,000 policies"]),
}


def panels_sql(rows, scales, lower):
    scale = "CASE metric1 " + " ".join(f"WHEN '{n}' THEN {f}::DOUBLE" for n, f in scales.items()) + " ELSE 1.0::DOUBLE END" if scales else "1.0::DOUBLE"
    low = "metric1 IN (" + ", ".join(f"'{n}'" for n in lower) + ")" if lower else "false"
    return f"""WITH m AS ({long_sql('entity', rows)})
, r AS (SELECT fy, q, metric1, entity, cur * ({scale}) AS cur, prior * ({scale}) AS prior FROM m WHERE coalesce(cur, prior) IS NOT NULL)
, e AS (SELECT fy, q, metric1, bool_or(prior IS NOT NULL) AS two_bars, max(cur) AS hi, min(cur) AS lo FROM r GROUP BY ALL)
SELECT r.*, two_bars, coalesce(cur = CASE WHEN {low} THEN lo ELSE hi END, false) AS leads FROM r JOIN e USING (fy, q, metric1)"""


def panel_table(number):
    rows, scales, lower = PANELS[number]
    metrics = [m for m in formulas.COMPANY_METRICS if m.slide == number]

    def run(spark, sf_dir):
        long = formulas.evaluate(wide_metrics(spark, sf_dir, ["entity"]), ["entity", "fy", "q"], metrics, {r[1] for r in rows})
        return report.panels(long, ["fy", "q"], "entity", scales, lower)

    return run


for _number, _def in PANELS.items():
    query(f"rpt_{_number}", panels_sql(*_def))(panel_table(_number))


# ---- trends ----------------------------------------------------------------------------

TRENDS = {
    # slide: title -> (column over year-to-date measures, the same in SQL); annualized titles
    15: ({"ats": (lambda: F.round(F.try_divide(F.col("gross") * 1e7, F.col("policies")), 2), "round(gross * 1e7::DOUBLE / policies, 2)"),
          "productivity": (lambda: ratio(F.col("gross") * 100, F.col("quantity")), "round(gross * 100 / nullif(quantity, 0), 4)")}, ["productivity"]),
    31: ({"gwp": (lambda: F.col("gross") + F.col("accepted"), "gross + accepted"), "pbt": (lambda: F.col("commission"), "commission")}, []),
    32: ({"combined": (lambda: formulas.expense_ratio(_v) + formulas.loss_ratio(_v), f"{EXPENSE} + {LOSS}"), "loss": (lambda: formulas.loss_ratio(_v), LOSS)}, []),
    33: ({"expense": (lambda: formulas.expense_ratio(_v), EXPENSE),
          "management": (lambda: ratio(F.col("commission") + F.col("opex") - F.col("manpower"), F.col("gross") + F.col("accepted")),
                         "round((commission + opex - manpower) / nullif(gross + accepted, 0), 4)")}, []),
    34: ({"ceding": (lambda: ratio(F.col("ceded"), F.col("gross")), "round(ceded / nullif(gross, 0), 4)"),
          "commission_to_ceding": (lambda: ratio(F.col("accepted"), F.col("ceded")), "round(accepted / nullif(ceded, 0), 4)")}, []),
    35: ({"roe": (lambda: ratio(F.col("opex"), F.col("value")), "round(opex / nullif(value, 0), 4)"),
          "solvency": (lambda: as_multiple(ratio(F.col("gross"), F.col("ceded"))),
                       "CASE WHEN round(gross / nullif(ceded, 0), 4) > 20 THEN round(gross / nullif(ceded, 0), 4) / 100 ELSE round(gross / nullif(ceded, 0), 4) END")}, []),
    36: ({"aum": (lambda: F.col("gross"), "gross"), "yield": (lambda: ratio(F.col("commission"), F.col("gross")), "round(commission / nullif(gross, 0), 4)")}, ["yield"]),
    37: ({"aum_shareholders": (lambda: F.col("value"), "value"), "aum_policyholders": (lambda: F.col("earned"), "earned")}, []),
    38: ({"employees": (lambda: F.col("quantity"), "quantity"), "agents": (lambda: F.col("policies"), "policies")}, []),
    39: ({"offices": (lambda: F.col("claims_reported"), "claims_reported")}, []),
}
TREND_MEASURES = ["gross", "accepted", "value", "earned", "claims", "commission", "opex", "manpower", "ceded", "claims_reported", "quantity", "policies"]


def _v(name):
    return F.col({"net_commission": "commission", "nwp": "value"}.get(name, name))


def trend_sql(titles, annual):
    cum = ", ".join(f"CAST(SUM(CAST({m} AS DECIMAL(38,4))) OVER (PARTITION BY entity, fy ORDER BY q) AS DOUBLE) AS {m}" for m in TREND_MEASURES)
    now = {m: m for m in TREND_MEASURES}
    long = " UNION ALL ".join(
        f"SELECT '{t}' AS title, entity, fy, q, {'(' + e.format(**now) + ') * (12 / (q * 3))' if t in annual else e.format(**now)} AS value FROM ytd"
        for t, (_, e) in titles.items())
    return panel_sql("entity, fy, q", ", ".join(TREND_MEASURES)) + f""", ytd AS (SELECT entity, fy, q, {cum} FROM panel)
, long AS ({long}), periods AS (SELECT DISTINCT fy, q FROM panel)
SELECT p.fy AS report_fy, p.q AS report_q, title, entity, 'FY' || lpad(CAST((y.fy + 1) % 100 AS VARCHAR), 2, '0') AS label, value
FROM periods p JOIN long y ON y.q = 4 AND y.fy + 1 <= CASE WHEN p.q = 4 THEN p.fy + 1 ELSE p.fy END WHERE value IS NOT NULL
UNION ALL SELECT fy, q, title, entity, 'Q' || q || ' FY' || lpad(CAST((fy + 1) % 100 AS VARCHAR), 2, '0'), value FROM long WHERE q < 4 AND value IS NOT NULL"""


def trend_table(number):
    titles, annual = TRENDS[number]

    def run(spark, sf_dir):
        p = panel(spark, sf_dir, ["entity", "fy", "q"], TREND_MEASURES)
        ytd = series.year_to_date(p, ["entity"], TREND_MEASURES)
        ytd = ytd.select("entity", "fy", "q", *[c().alias(t) for t, (c, _) in titles.items()])
        return report.trends(ytd, "entity", list(titles), report_periods(spark, sf_dir), annual)

    return run


for _number, (_titles, _annual) in TRENDS.items():
    query(f"rpt_{_number}", trend_sql(_titles, _annual))(trend_table(_number))


@query("rpt_14", paired_sql("entity, segment, q", "gross") + f"""
, r AS (SELECT entity, q, fy, gross, gross_prior FROM pairs WHERE segment = 'AUTOMOBILE')
, y AS (SELECT entity, fy, q, CAST(SUM(CAST(gross AS DECIMAL(38,4))) OVER w AS DOUBLE) AS revenue,
   CAST(SUM(CAST(gross_prior AS DECIMAL(38,4))) OVER w AS DOUBLE) AS revenue_prior FROM r WINDOW w AS (PARTITION BY entity, fy ORDER BY q))
SELECT entity, fy, q, revenue, CAST(round(CAST(revenue AS DECIMAL(38,4)) - CAST(revenue_prior AS DECIMAL(38,4)), 2) AS DOUBLE) AS accretion FROM y""")
def rpt_14(spark, sf_dir):
    p = paired_panel(spark, sf_dir, ["entity", "segment", "q", "fy"], ["gross"]).where(F.col("segment") == "AUTOMOBILE")
    ytd = series.year_to_date(p, ["entity"], ["gross", "gross_prior"])
    money = lambda c: F.col(c).cast(series.MONEY)
    return ytd.select("entity", "fy", "q", F.col("gross").alias("revenue"),
                      series.accretion(money("gross"), money("gross_prior")).cast("double").alias("accretion"))


@query("rpt_39_intermediaries", f"""WITH {FACTS}
, b AS (SELECT fy, q, channel, entity, CAST(COUNT(DISTINCT okey) AS DOUBLE) AS cur, CAST(NULL AS DOUBLE) AS prior FROM facts GROUP BY ALL)
, t AS (SELECT fy, q, channel, SUM(cur) AS total FROM b GROUP BY ALL)
SELECT fy, q, channel, entity, cur, cur / total AS share, cur / total >= 0.04 AS labelled FROM b JOIN t USING (fy, q, channel)""")
def rpt_39_intermediaries(spark, sf_dir):
    p = panel(spark, sf_dir, ["channel", "entity", "fy", "q"], ["policies"]).withColumnRenamed("policies", "cur")
    out = report.stacked(p.withColumn("prior", F.lit(None).cast("double")), ["fy", "q"], "channel", "entity")
    return out.select("fy", "q", "channel", "entity", "cur", "share", "labelled")


@query("rpt_40", long_sql("entity, nationkey", [(22, "Combined Ratio", None, f"{EXPENSE} + {LOSS}", False), (22, "Loss Ratio", None, LOSS, False)]).replace(
    "\nSELECT entity", "\n, m AS (SELECT entity", 1) + """)
, d AS (SELECT *, cur - prior AS change FROM m WHERE cur IS NOT NULL)
, l AS (SELECT fy, q, metric1, min_by(entity, (cur, nationkey)) AS leader, min(cur) AS leader_value,
   max_by(entity, (change, -nationkey)) FILTER (change IS NOT NULL) AS best, max(change) AS best_d,
   min_by(entity, (change, nationkey)) FILTER (change IS NOT NULL) AS worst, min(change) AS worst_d FROM d GROUP BY ALL)
SELECT fy, q, metric1, 1 AS line, 'leader' AS kind, leader AS entity, leader_value AS number FROM l
UNION ALL SELECT fy, q, metric1, 2, 'improved', best, best_d FROM l WHERE best_d > 1e-9
UNION ALL SELECT fy, q, metric1, 3, 'declined', worst, worst_d FROM l WHERE worst_d < -1e-9 AND worst <> best""")
def rpt_40(spark, sf_dir):
    wide = wide_metrics(spark, sf_dir, ["entity", "nationkey"])
    long = formulas.evaluate(wide, ["entity", "nationkey", "fy", "q"], formulas.COMPANY_METRICS, {"Combined Ratio", "Loss Ratio"})
    return series.insight_rows(
        long, ["fy", "q", "metric1"], entity="entity", order="nationkey", cur="cur", prior="prior", higher_is_better=False)

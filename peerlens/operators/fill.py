"""Filling the metric table from other tables: lookups, wildcard lookups, backfills.

A row that has both periods is never touched; any other row takes the non-null sides of what it
matches, and its growth is computed on the matched values.  Sources are reduced to one row per key
first, so every join is a plain equi join that cannot multiply rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import growth
from ..functions.text import fold_text


def first_per_key(df: DataFrame, keys: Sequence[str], order: str, values: Sequence[str]) -> DataFrame:
    """The row first in order for each key."""
    return df.groupBy(*keys).agg(F.min_by(F.struct(*values), F.col(order)).alias("_r")).select(
        *keys, *[F.col(f"_r.{v}").alias(v) for v in values])


def last_per_key(df: DataFrame, keys: Sequence[str], order: str, values: Sequence[str]) -> DataFrame:
    """The row last in order for each key: later writes win."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*values), F.col(order)).alias("_r")).select(
        *keys, *[F.col(f"_r.{v}").alias(v) for v in values])


def _filled(state: tuple[Column, Column, Column], cur: Column, prior: Column, force: bool = False):
    """One application of the fill rule to (cur, prior, growth)."""
    c, p, g = state
    use = F.coalesce(cur, prior).isNotNull()
    if not force:
        use = use & (c.isNull() | p.isNull())
    return (
        F.when(use, F.coalesce(cur, c)).otherwise(c),
        F.when(use, F.coalesce(prior, p)).otherwise(p),
        F.when(use, F.coalesce(growth(cur, prior), g)).otherwise(g),
    )


def _met(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds _k_ columns by which keys meet: texts trimmed, an empty text the same as none."""
    kinds = dict(df.dtypes)
    meet = lambda k: F.coalesce(F.trim(F.col(k)), F.lit("")) if kinds[k] == "string" else F.col(k)
    return df.withColumns({f"_k_{k}": meet(k) for k in keys})


def _equal(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[f"_k_{k}"].eqNullSafe(right[f"_s_{k}"])
    return cond


def fill_exact(
    target: DataFrame, source: DataFrame, keys: Sequence[str], force: bool = False, digits: int = 4, order: str | None = None
) -> DataFrame:
    """Exact lookup on all keys (no key meets no key, as does an empty text); values are stored rounded.

    Of several source rows with a key the last by `order` counts; without an order, the one with the largest figures.
    """
    rank = F.col(order) if order else F.struct("cur", "prior")
    src = _met(source, keys).groupBy(*[F.col(f"_k_{k}").alias(f"_s_{k}") for k in keys]).agg(
        F.max_by(F.struct("cur", "prior"), rank).alias("_v"))
    src = src.select(
        *[f"_s_{k}" for k in keys], F.round("_v.cur", digits).alias("_c"), F.round("_v.prior", digits).alias("_p"),
        growth(F.col("_v.cur"), F.col("_v.prior")).alias("_g"), F.coalesce("_v.cur", "_v.prior").isNotNull().alias("_has"))
    rows = _met(target, keys)
    joined = rows.join(src, _equal(rows, src, keys), "left")
    use = F.coalesce("_has", F.lit(False))
    if not force:
        use = use & (F.col("cur").isNull() | F.col("prior").isNull())
    return joined.withColumns(
        {
            "cur": F.when(use, F.coalesce("_c", "cur")).otherwise(F.col("cur")),
            "prior": F.when(use, F.coalesce("_p", "prior")).otherwise(F.col("prior")),
            "growth": F.when(use, F.coalesce("_g", "growth")).otherwise(F.col("growth")),
        }
    ).select(*target.columns)


def unmatched(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows still lacking a period that the source has no value for."""
    usable = _met(source.where(F.coalesce("cur", "prior").isNotNull()), keys).select(
        *[F.col(f"_k_{k}").alias(f"_s_{k}") for k in keys]).distinct()
    lacking = _met(target.where(F.col("cur").isNull() | F.col("prior").isNull()), keys)
    return lacking.join(usable, _equal(lacking, usable, keys), "left_anti").select(*target.columns)


def fill_wildcard(target: DataFrame, source: DataFrame, keys: Sequence[str], order: str = "ord") -> DataFrame:
    """Lookup on folded labels where a source without metric2 matches every metric2.

    keys: period-like columns beside slide, company, metric1, metric2.  A row can meet one exact and
    one wildcard source; they are applied in their order.
    """
    def folded(df: DataFrame) -> DataFrame:
        return df.withColumns({"_company": fold_text(F.col("company")), "_m1": fold_text(F.col("metric1")),
                               "_m2": fold_text(F.col("metric2"))})

    base = [*keys, "slide", "_company", "_m1"]
    usable = folded(source.where(F.coalesce("cur", "prior").isNotNull()))
    exact = first_per_key(usable.where(F.col("metric2").isNotNull()), [*base, "_m2"], order, [order, "cur", "prior"])
    wild = first_per_key(usable.where(F.col("metric2").isNull()), base, order, [order, "cur", "prior"])
    exact = exact.withColumnsRenamed({order: "_eo", "cur": "_ec", "prior": "_ep"})
    wild = wild.withColumnsRenamed({order: "_wo", "cur": "_wc", "prior": "_wp"})
    rows = folded(target).join(exact, [*base, "_m2"], "left").join(wild, base, "left")

    start = (F.col("cur"), F.col("prior"), F.col("growth"))
    exact_first = _filled(_filled(start, F.col("_ec"), F.col("_ep")), F.col("_wc"), F.col("_wp"))
    wild_first = _filled(_filled(start, F.col("_wc"), F.col("_wp")), F.col("_ec"), F.col("_ep"))
    swap = F.coalesce(F.col("_wo") < F.col("_eo"), F.lit(False))
    out = {n: F.when(swap, w).otherwise(e) for n, e, w in zip(("cur", "prior", "growth"), exact_first, wild_first)}
    return rows.withColumns(out).select(*target.columns)


def in_targets(df: DataFrame, targets: DataFrame) -> DataFrame:
    """Rows named by a target list of (slide, metric1, metric2), metric2 null meaning any."""
    def folded(d: DataFrame) -> DataFrame:
        return d.withColumns({"_m1": fold_text(F.col("metric1")), "_m2": fold_text(F.col("metric2"))})

    listed, rows = folded(targets), folded(df)
    exact = listed.where(F.col("metric2").isNotNull()).select("slide", "_m1", "_m2", F.lit(True).alias("_e")).distinct()
    wild = listed.where(F.col("metric2").isNull()).select("slide", "_m1", F.lit(True).alias("_w")).distinct()
    hit = rows.join(exact, ["slide", "_m1", "_m2"], "left").join(wild, ["slide", "_m1"], "left")
    return hit.where(F.coalesce("_e", "_w").isNotNull()).select(*df.columns)


def backfill_prior(
    target: DataFrame, archive: DataFrame, targets: DataFrame, fy: str = "fy", q: str = "q", order: str = "row_no"
) -> DataFrame:
    """A missing prior value takes last year's current one, for listed metrics only.

    The archive's own first row for a key counts, and a value found in this year's filing stays.
    """
    keys = ["slide", "_company", "_m1", "_m2", q, fy]

    def folded(df: DataFrame) -> DataFrame:
        return df.withColumns({"_company": fold_text(F.col("company")), "_m1": fold_text(F.col("metric1")),
                               "_m2": fold_text(F.col("metric2"))})

    last_year = folded(in_targets(archive, targets)).withColumn(fy, F.col(fy) + 1)
    source = first_per_key(last_year, keys, order, ["cur"]).select(*keys, F.col("cur").alias("_h"))
    rows = folded(target).join(source, keys, "left")
    use = F.col("prior").isNull() & F.col("_h").isNotNull()
    return rows.withColumns(
        {
            "growth": F.when(use, F.coalesce(growth(F.col("cur"), F.col("_h")), F.col("growth"))).otherwise(F.col("growth")),
            "prior": F.coalesce("prior", "_h"),
        }
    ).select(*target.columns)


def prefer(primary: Column, fallback: Column) -> Column:
    """The authoritative figure unless it is missing or zero while the fallback has one."""
    return F.coalesce(F.nullif(primary, F.lit(0.0)), F.nullif(fallback, F.lit(0.0)), primary, fallback)


def shift_bucket(df: DataFrame, by: Sequence[str], bucket: str, value: str, empty: str, source: str) -> DataFrame:
    """When bucket `empty` has no value and `source` has one, the value is booked under `empty`."""
    have = df.groupBy(*by).agg(
        F.max(F.when((F.col(bucket) == empty) & F.col(value).isNotNull(), True)).alias("_a"),
        F.max(F.when((F.col(bucket) == source) & F.col(value).isNotNull(), True)).alias("_b"),
    )
    out = df.join(have, list(by))
    moves = F.col("_a").isNull() & F.col("_b").isNotNull()
    swapped = F.when(F.col(bucket) == empty, source).when(F.col(bucket) == source, empty).otherwise(F.col(bucket))
    return out.withColumn(bucket, F.when(moves, swapped).otherwise(F.col(bucket))).drop("_a", "_b")


def best_ranked(df: DataFrame, by: Sequence[str], candidate: str, rank: str, valid: Column) -> DataFrame:
    """The best-ranked valid candidate of each group, whatever order they finish in."""
    return df.where(valid).groupBy(*by).agg(F.min_by(candidate, rank).alias(candidate), F.min(rank).alias(rank))


def first_n(df: DataFrame, by: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The first n rows of each group in order, with their place; a task keeps n rows of a group before anything moves."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def regroup_by_form(specs: DataFrame, results: DataFrame, keys: Sequence[str], holders: DataFrame | None = None) -> DataFrame:
    """Every spec of every form for every holder with its result; what a holder has no result for counts as not found.

    holders: who is expected to have the specs (`keys`), by default everyone with any result.  The specs are a short list
    and travel as one array per holder, so no row meets another by the spec key alone.
    """
    listed = specs.select("key", "kind", F.explode("forms").alias("form"))
    items = [F.struct(*[F.lit(r[c]).alias(c) for c in ("form", "key", "kind")]) for r in listed.collect()]  # the list itself
    wanted = (holders or results).select(*keys).distinct().select(*keys, F.inline(F.array(*items)))
    met = wanted.join(results.select(*keys, "key", "found", "cur", "prior"), [*keys, "key"], "left")
    return met.withColumn("found", F.coalesce("found", F.lit(False))).select(*keys, "form", "key", "kind", "found", "cur", "prior")


def expected_minus_found(expected: DataFrame, found: DataFrame, keys: Sequence[str]) -> DataFrame:
    return expected.join(found.select(*keys).distinct(), list(keys), "left_anti")


def targets_without_rows(targets: DataFrame, rows: DataFrame) -> DataFrame:
    """Registry targets that no row of the table answers, metric2 null meaning any."""
    def folded(df: DataFrame) -> DataFrame:
        return df.withColumns({"_m1": fold_text(F.col("metric1")), "_m2": fold_text(F.col("metric2"))})

    listed, have = folded(targets), folded(rows)
    exact = listed.where(F.col("metric2").isNotNull()).join(
        have.select("slide", "_m1", "_m2").distinct(), ["slide", "_m1", "_m2"], "left_anti")
    wild = listed.where(F.col("metric2").isNull()).join(have.select("slide", "_m1").distinct(), ["slide", "_m1"], "left_anti")
    return exact.unionByName(wild).select(*targets.columns)


def both_differences(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys only one side has, with the side that has them."""
    a, b = left.select(key), right.select(key)
    return a.exceptAll(b).withColumn("only_in", F.lit("left")).unionByName(
        b.exceptAll(a).withColumn("only_in", F.lit("right")))


def rate_across(top: DataFrame, bottom: DataFrame, spellings: DataFrame, by: Sequence[str], name: str, other: str) -> DataFrame:
    """by, other, cur, prior, cur_rate, prior_rate: figures of one schedule over those of another that spells its rows differently.

    top: by, name, cur, prior; bottom: by, other, cur, prior; spellings: name -> other.  Rows of several names for one
    `other` are added up before they meet it; a rate over nothing is null.
    """
    by, money = list(by), lambda c: F.sum(F.col(c).cast("decimal(24,4)")).cast("double").alias(c)
    named = top.join(spellings.select(name, other).distinct(), name).groupBy(*by, other).agg(money("cur"), money("prior"))
    under = bottom.select(*by, other, F.col("cur").alias("_cur"), F.col("prior").alias("_prior"))
    rate = lambda c: F.round(F.try_divide(F.col(c), F.col(f"_{c}")), 4).alias(f"{c}_rate")
    return named.join(under, [*by, other]).select(*by, other, "cur", "prior", rate("cur"), rate("prior"))

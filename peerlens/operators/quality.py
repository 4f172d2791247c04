"""Reconciliation, coverage, contract and traceability checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import fixed_text
from ..functions.text import plain_number, stated_numbers, traceable_tokens
from .series import MONEY


def mix_failures(df: DataFrame, by: Sequence[str], share: str, parts: int, tolerance: float = 0.005) -> DataFrame:
    """Groups whose shares do not add up to one, or that lack a part."""
    sums = df.where(F.col(share).isNotNull()).groupBy(*by).agg(
        F.sum(F.col(share).cast("decimal(18,6)")).cast("double").alias("total"), F.count("*").alias("parts"))
    return sums.where((F.col("parts") < parts) | (F.abs(F.col("total") - 1) > tolerance)).withColumn(
        "total", F.round("total", 6))


def mix_footnotes(df: DataFrame, by: Sequence[str], share: str, points: float = 0.01) -> DataFrame:
    """Whether a mix needs a footnote; shares are never rescaled."""
    return df.groupBy(*by).agg(F.sum(F.col(share).cast("decimal(18,6)")).cast("double").alias("total")).withColumn(
        "footnote", F.abs(F.col("total") - 1) > points)


def parts_against_total(
    parts: DataFrame, totals: DataFrame, keys: Sequence[str], value: str, tolerance: float = 0.005
) -> DataFrame:
    """Printed totals that the sum of their parts misses by more than the tolerance."""
    sums = parts.groupBy(*keys).agg(F.sum(F.col(value).cast(MONEY)).cast("double").alias("summed"))
    both = totals.select(*keys, F.col(value).alias("printed")).join(sums, list(keys))
    return both.where((F.col("printed") != 0) & (F.abs(F.col("summed") - F.col("printed")) > tolerance * F.col("printed")))


def split_contract(df: DataFrame, found: str = "found", cur: str = "cur", prior: str = "prior") -> tuple[DataFrame, DataFrame]:
    """(valid, quarantined): a found value has a current figure, one not found has none at all."""
    ok = contract_holds(F.col(found), F.col(cur), F.col(prior))
    return df.where(ok), df.where(~ok)


def contract_holds(found: Column, cur: Column, prior: Column) -> Column:
    found = F.coalesce(found, F.lit(False))
    return (found & cur.isNotNull()) | (~found & cur.isNull() & prior.isNull())


def sparse_slides(df: DataFrame, by: Sequence[str], entity: str, value: str, at_least: int = 2) -> DataFrame:
    """Slides with fewer populated entities than worth showing."""
    return df.groupBy(*by).agg(
        F.count_distinct(F.when(F.col(value).isNotNull(), F.col(entity))).alias("entities")
    ).where(F.col("entities") < at_least)


def missing_coverage(expected: DataFrame, rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Expected keys without a populated row."""
    have = rows.where(F.col(value).isNotNull()).select(*keys).distinct()
    return expected.join(have, list(keys), "left_anti")


def outside_band(df: DataFrame, bands: DataFrame, kind: str, value: str) -> DataFrame:
    """Values outside the plausible band of their kind, for review; nothing is dropped from the table."""
    joined = df.join(bands.select(kind, "low", "high"), kind)
    return joined.where(F.col(value).isNotNull() & ~F.col(value).between(F.col("low"), F.col("high")))


def renderings(value: Column) -> Column:
    """Every tolerated way to write a value: times 1 or 100, 0 to 4 decimals, sign left out."""
    forms = [fixed_text(F.abs(value) * scale, digits) for scale in (1, 100) for digits in range(5)]
    return F.array_distinct(F.transform(F.array(*forms), plain_number))


def untraceable(texts: DataFrame, doc: str, text: str, values: DataFrame, value: str) -> DataFrame:
    """doc, token: numbers stated in a text that no value of the table can be written as.

    Texts are reduced to their distinct tokens and values to their distinct renderings before the two
    meet, so a number that half of the texts repeat crosses the shuffle once per text, not per use.
    """
    tokens = texts.select(doc, F.explode(traceable_tokens(stated_numbers(F.col(text)))).alias("token"))
    allowed = values.where(F.col(value).isNotNull()).select(F.explode(renderings(F.col(value))).alias("token")).distinct()
    stated = tokens.select("token").distinct()
    unknown = stated.join(allowed, "token", "left_anti")
    return tokens.join(unknown, "token", "left_semi").select(doc, "token")

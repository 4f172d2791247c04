"""Statistics workbooks laid out in blocks of current / previous-year row pairs.

Input rows: keys, r (dense row number), cells ARRAY<STRING> with blanks as null.  Sheets are read
all at once; a sheet of any length is scanned in runs, never as one window partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import to_double
from ..functions.scans import carry_forward
from ..functions.text import fold_label
from ..operators.fill import last_per_key

MARKET_SHARE = "% Market Share"
MARKET_SHARE_PRIOR = "Previous Year Market Share"
GROWTH_ROW = "% Growth"


def _numbers(cells: Column) -> Column:
    return F.transform(F.slice(cells, 2, F.greatest(F.size(cells) - 1, F.lit(0))), to_double)


def _prepared(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows below the sheet's header, with the header's column names and the row's kind."""
    first, second = F.get("cells", F.lit(0)), F.get("cells", F.lit(1))
    is_header = first.isNull() & second.isNotNull() & to_double(second).isNull()
    headers = rows.where(is_header).groupBy(*keys).agg(F.min_by(F.struct("r", "cells"), "r").alias("h"))
    names = F.filter(F.slice("h.cells", 2, F.greatest(F.size("h.cells") - 1, F.lit(0))), lambda c: c.isNotNull())
    headers = headers.select(*keys, F.col("h.r").alias("_hr"), names.alias("names"))
    body = rows.join(headers, list(keys)).where(F.col("r") > F.col("_hr"))
    values = F.slice(_numbers(F.col("cells")), 1, F.greatest(F.size("names"), F.lit(1)))
    body = body.select(*keys, "r", "names", first.alias("label"), values.alias("vals"))
    numeric = F.exists("vals", lambda v: v.isNotNull())
    kind = (
        F.when(F.col("label").isNull() | ~numeric, "text")
        .when(F.col("label") == GROWTH_ROW, "growth")
        .when(F.col("label").isin(MARKET_SHARE, MARKET_SHARE_PRIOR), "share")
        .otherwise("data")
    )
    return body.withColumn("kind", kind).withColumn(
        "is_prev", F.coalesce(F.col("label").contains("Previous Year"), F.lit(False)))


def read_block_sheet(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, label, col, cur, prev: every pair of rows, one output row per column; a later label wins."""
    keys = list(keys)
    body = _prepared(rows, keys)
    # a previous-year row belongs to the row above it, unless that one is itself such a row and taken
    scanned = carry_forward(
        body.withColumns({"_nr": F.when(~F.col("is_prev"), F.col("r")), "_nk": F.when(~F.col("is_prev"), F.col("kind"))}),
        keys, "r", {"_base_r": "_nr", "_base_kind": "_nk"})
    place = F.col("r") - F.col("_base_r")
    taken = F.when(F.col("_base_kind") == "data", place % 2 == 1).otherwise(place % 2 == 0)
    taken = F.col("is_prev") & F.coalesce(taken, F.lit(False))
    # a taken row joins its head, one row up; the two meet in one grouping
    heads = scanned.withColumn("_taken", taken).where((F.col("kind") == "data") | F.col("_taken"))
    pairs = heads.groupBy(*keys, F.when(F.col("_taken"), F.col("r") - 1).otherwise(F.col("r")).alias("r")).agg(
        F.max(F.when(~F.col("_taken"), F.struct(F.trim("label").alias("label"), "names", "vals"))).alias("_h"),
        F.max(F.when(F.col("_taken"), F.col("vals"))).alias("_prev"),
    ).where(F.col("_h").isNotNull())
    long = pairs.select(
        *keys, "r", F.col("_h.label").alias("label"), F.posexplode("_h.names").alias("_i", "col"),
        F.col("_h.vals").alias("vals"), "_prev",
    ).select(*keys, "r", "label", "col", F.get("vals", F.col("_i")).alias("cur"), F.get("_prev", F.col("_i")).alias("prev"))
    return last_per_key(long, [*keys, "label", "col"], "r", ["cur", "prev"])


def read_market_share(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, col, cur, prev from the footer's two market share rows."""
    share = _prepared(rows, keys).where(F.col("kind") == "share")
    long = share.select(
        *keys, "r", (F.col("label") == MARKET_SHARE).alias("_now"), F.posexplode("names").alias("_i", "col"), "vals"
    ).withColumn("v", F.get("vals", F.col("_i")))
    return long.groupBy(*keys, "col").agg(
        F.max_by("v", F.when(F.col("_now"), F.col("r"))).alias("cur"),
        F.max_by("v", F.when(~F.col("_now"), F.col("r"))).alias("prev"),
    )


def lookup_columns(sheet: DataFrame, wanted: DataFrame, keys: Sequence[str], row: str) -> DataFrame:
    """Figures of one row for wanted columns matched on their folded names.

    `wanted` lists names per the same keys; a name without a column comes back flagged as missing.
    """
    have = sheet.where(F.col("label") == row).select(
        *keys, fold_label(F.col("col")).alias("_f"), "cur", "prev", F.lit(True).alias("_hit"))
    asked = wanted.withColumn("_f", fold_label(F.col("name")))
    return asked.join(have, [*keys, "_f"], "left").select(
        *keys, "name", "cur", "prev", F.col("_hit").isNull().alias("missing"))


def entity_totals(sheet: DataFrame, labels: DataFrame, keys: Sequence[str], column: str = "Grand Total") -> DataFrame:
    """keys, entity, cur, prior: each entity's figure in a sheet's total column; without one it has no row.

    labels: entity, label - how the sheet spells the entity.
    """
    total = sheet.where(fold_label(F.col("col")) == fold_label(F.lit(column))).where(F.coalesce("cur", "prev").isNotNull())
    spelled = labels.select("entity", F.trim("label").alias("label")).distinct()
    return total.join(spelled, "label").select(*keys, "entity", "cur", F.col("prev").alias("prior"))

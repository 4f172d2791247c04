"""Multi-year workbooks: stacked title / header / body blocks, one column per year.

Input rows: keys, r (dense row number), cells ARRAY<STRING> with blanks as null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import to_double
from ..functions.periods import year_sort_key
from ..functions.scans import running_sum
from ..operators.fill import last_per_key


def _blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def read_history(rows: DataFrame, keys: Sequence[str], entity_of) -> DataFrame:
    """keys, title, entity, year_label, fy_end, value.

    entity_of(label) gives the entity of a row label, null for labels that end a block.  The title is
    the text right above the header; of two blocks with one title the later one counts.
    """
    keys = list(keys)
    first = F.get("cells", F.lit(0))
    rows = rows.withColumn("_head", F.lower(F.trim(first)).startswith("particulars") & first.isNotNull())
    rows = rows.withColumn("_head", F.coalesce("_head", F.lit(False)))
    rows = running_sum(rows.withColumn("_one", F.col("_head").cast("bigint")), keys, "r", {"_block": "_one"})

    above = rows.where(~_blank(first) & ~F.col("_head")).select(
        *keys, (F.col("r") + 1).alias("r"), F.trim(F.regexp_replace(F.trim(first), ":+$", "")).alias("title"))
    year_cells = F.slice("cells", 2, F.greatest(F.size("cells") - 1, F.lit(0)))
    stop = F.array_position(F.transform(year_cells, lambda c: _blank(c)), True)
    years = F.when(stop > 0, F.slice(year_cells, 1, F.greatest(stop.cast("int") - 1, F.lit(0)))).otherwise(year_cells)
    heads = rows.where("_head").select(*keys, "r", "_block", F.transform(years, lambda y: F.trim(y)).alias("years"))
    heads = heads.join(above, [*keys, "r"], "left").withColumn("title", F.coalesce("title", F.lit("Untitled")))
    heads = heads.withColumnRenamed("r", "_hr")

    entity = F.when(~_blank(first), entity_of(first))
    body = rows.where((F.col("_block") > 0) & ~F.col("_head")).withColumn("entity", entity)
    ends = body.where(F.col("entity").isNull()).groupBy(*keys, "_block").agg(F.min("r").alias("_end"))
    inside = heads.join(ends, [*keys, "_block"], "left")
    long = (
        body.join(inside, [*keys, "_block"])
        .where(F.col("_end").isNull() | (F.col("r") < F.col("_end")))
        .select(*keys, "title", "entity", "r", "_block", F.posexplode("years").alias("_i", "year_label"), "cells")
        .withColumn("value", to_double(F.get("cells", F.col("_i") + 1)))
    )
    newest = heads.groupBy(*keys, "title").agg(F.max("_block").alias("_block"))
    long = long.join(newest, [*keys, "title", "_block"], "left_semi")
    out = last_per_key(long, [*keys, "title", "entity", "year_label"], "r", ["value"])
    return out.withColumn("fy_end", year_sort_key(F.col("year_label")))


def append_year(
    history: DataFrame, point: DataFrame, required: DataFrame, fy_end: int, quarter: int
) -> tuple[DataFrame, DataFrame]:
    """History with a completed year added, and the titles left alone with the reason.

    A title that has the year is never touched; a title lacking a value for any entity it charts is
    skipped whole; entities outside `required` may stay blank.
    """
    if quarter != 4:
        raise ValueError("only the last quarter completes a year")
    titles = history.groupBy("title").agg(F.max(F.col("fy_end") == fy_end).alias("_has"))
    open_titles = titles.where(~F.col("_has")).select("title")
    charted = history.join(open_titles, "title", "left_semi").select("title", "entity").distinct()
    planned = charted.join(point.select("title", "entity", "value"), ["title", "entity"], "left")
    lacking = (
        planned.join(required, "entity", "left_semi").where(F.col("value").isNull())
        .groupBy("title").agg(F.count("*").alias("missing"))
    )
    added = planned.join(lacking, "title", "left_anti").where(F.col("value").isNotNull())
    added = added.select("title", "entity", F.lit(fy_end).alias("fy_end"), "value")
    skipped = lacking.select("title", F.lit("no value for a required entity").alias("reason"), "missing").unionByName(
        titles.where("_has").select("title", F.lit("already has the year").alias("reason"), F.lit(0).cast("bigint").alias("missing")))
    return history.select("title", "entity", "fy_end", "value").unionByName(added), skipped

"""Workbook-shaped input rendered from the panel: what the sheet readers are tested and run on."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.periods import fy_end_label
from ..operators.series import exact_sum
from .panel import paired_panel, panel
from .panel import years as span

SEGMENT_COLUMNS = {"AUTOMOBILE": "Marine  Cargo", "BUILDING": "Fire", "FURNITURE": "Health ", "HOUSEHOLD": "Aviation ", "MACHINERY": "P.A."}


def block_sheets(spark, sf_dir):
    """sheet, fy, q, r, cells: one sheet per measure and period, groups with their pairs, subtotals and footer."""
    measures = ["value", "gross"]
    base = paired_panel(spark, sf_dir, ["grp", "entity", "segment", "q", "fy"], measures)
    long = base.select(
        "grp", "entity", "segment", "q", "fy",
        F.inline(F.array(
            F.struct(F.lit("segment").alias("sheet"), F.col("value").alias("cur"), F.col("value_prior").alias("prev")),
            F.struct(F.lit("health").alias("sheet"), F.col("gross").alias("cur"), F.col("gross_prior").alias("prev")))))
    keys = [F.col(c) for c in ("sheet", "fy", "q", "grp", "entity", "segment")]
    g, e, s = keys[3], keys[4], keys[5]
    sets = [[*keys[:3], *x] for x in ([g, e, s], [g, e], [g, s], [g], [s], [])]
    sums = long.groupingSets(sets, *keys).agg(exact_sum(F.col("cur")).alias("cur"), exact_sum(F.col("prev")).alias("prev"))
    sums = sums.withColumn("column", F.coalesce("segment", F.lit("TOTAL")))

    def wide(c):
        at = lambda n: F.max(F.when(F.col("column") == n, F.col(c)))
        return F.array(*[at(n) for n in (*SEGMENT_COLUMNS, "TOTAL")]).alias(c)

    units = sums.groupBy("sheet", "fy", "q", "grp", "entity").agg(wide("cur"), wide("prev"))
    text = lambda arr: F.transform(arr, lambda v: v.cast("string"))
    blank = F.array_repeat(F.lit(None).cast("string"), len(SEGMENT_COLUMNS) + 1)
    row = lambda sub, label, cells: F.struct(
        F.lit(sub).alias("sub"), F.concat(F.array(label), cells).alias("cells"))
    pct = lambda a, b: F.transform(F.arrays_zip(a.alias("x"), b.alias("y")),
                                   lambda z: F.round(F.try_divide(z["x"] - z["y"], z["y"]) * 100, 2).cast("string"))
    share = lambda a: F.transform(a, lambda v: F.try_divide(v, F.element_at(a, -1)).cast("string"))
    cur, prev = F.col("cur"), F.col("prev")
    prior = F.lit("Previous Year")
    entity_rows = F.array(row(1, F.col("entity"), text(cur)), row(2, prior, text(prev)))
    group_rows = F.array(
        row(1, F.concat("grp", F.lit(" sub Total")), text(cur)), row(2, F.lit("Previous Year Sub Total"), text(prev)),
        row(3, F.lit("% Growth"), pct(cur, prev)))
    header = F.concat(F.array(F.lit(None).cast("string")), F.array(*[F.lit(c) for c in (*SEGMENT_COLUMNS.values(), "Grand Total")]))
    footer = F.array(
        F.struct(F.lit(1).alias("sub"), F.concat(F.array(F.lit("Industry Total")), text(cur)).alias("cells")),
        row(2, F.lit("Previous Year Sub Total"), text(prev)), row(3, F.lit("% Growth"), pct(cur, prev)),
        row(4, F.lit("% Market Share"), share(cur)), row(5, F.lit("Previous Year Market Share"), share(prev)))
    section = row(0, F.concat("grp", F.lit(" Insurers")), blank)
    title = F.array(F.struct(F.lit(-2).alias("sub"), F.concat(F.array(F.lit("Premium statistics")), blank).alias("cells")),
                    F.struct(F.lit(-1).alias("sub"), header.alias("cells")))
    k = ["sheet", "fy", "q"]
    # each aggregate row knows which sheet rows it prints
    printed = (
        F.when(F.col("entity").isNotNull(), entity_rows)
        .when(F.col("grp").isNotNull(), F.concat(F.array(section), group_rows))
        .otherwise(F.concat(title, footer))
    )
    rows = units.select(*k, "grp", "entity", F.inline(printed))
    sub = F.col("sub")
    rows = rows.select(
        *k, "sub", "cells",
        F.when(F.col("grp").isNotNull(), F.col("grp")).when(sub < 0, " ").otherwise("~").alias("grp"),
        F.when(F.col("entity").isNotNull(), 1).when(sub == 0, 0).otherwise(2).alias("part"),
        F.coalesce("entity", F.lit("")).alias("entity"))
    # a sheet has two rows per entity and a few per group: the dimension tables bound it
    order = Window.partitionBy(*k).orderBy("grp", "part", "entity", "sub")
    return rows.select(*k, (F.row_number().over(order) - 1).alias("r"), "cells")


def history_books(spark, sf_dir, measures=("value", "gross", "claims")):
    """segment (the book), r, cells: stacked yearly blocks of every measure, with total rows and blanks."""
    first, last = span(spark, sf_dir)
    years = list(range(first, last + 1))
    p = panel(spark, sf_dir, ["segment", "entity", "fy"], measures)
    long = p.unpivot(["segment", "entity", "fy"], list(measures), "title", "value")
    keys = [F.col(c) for c in ("segment", "title", "entity")]
    sums = long.groupingSets([keys, keys[:2]], *keys).agg(
        F.array(*[exact_sum(F.when(F.col("fy") == y, F.col("value"))).cast("string") for y in years]).alias("vals"))
    nulls = F.array_repeat(F.lit(None).cast("string"), len(years))
    labels = F.array(*[fy_end_label(F.lit(y)) for y in years])
    line = lambda part, label, vals: F.struct(
        F.lit(part).alias("part"), F.concat(F.array(label), vals).alias("cells"))
    frame = F.array(
        line(0, F.concat(F.initcap("title"), F.lit(": ")), nulls), line(1, F.lit("Particulars (INR)"), labels),
        line(3, F.lit("Total"), F.col("vals")), line(4, F.lit(None).cast("string"), nulls))
    body = F.array(line(2, F.col("entity"), F.col("vals")))
    rows = sums.select(
        "segment", "title", F.coalesce("entity", F.lit("")).alias("entity"),
        F.inline(F.when(F.col("entity").isNull(), frame).otherwise(body)))
    order = Window.partitionBy("segment").orderBy("title", "part", "entity")
    return rows.select("segment", (F.row_number().over(order) - 1).alias("r"), "cells")

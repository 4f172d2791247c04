"""Parsed filings: nested JSON documents flattened to table rows and page texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import FILING


def read_filings(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Filings as stored: one JSON object per line, or one per file with multi_line."""
    return spark.read.schema(FILING).option("multiLine", multi_line).json(path)


def page_rows(filings: DataFrame, *keys: str) -> DataFrame:
    """keys, page, forms, text: one row per page."""
    pages = filings.select(*keys, F.explode("pages").alias("p"))
    return pages.select(*keys, F.col("p.page_number").alias("page"), F.col("p.forms_detected").alias("forms"), F.col("p.text").alias("text"))


def table_rows(filings: DataFrame, *keys: str) -> DataFrame:
    """keys, page, forms, tbl, r, cells: one row per table row, its cells kept together."""
    pages = filings.select(*keys, F.explode("pages").alias("p"))
    tables = pages.select(*keys, F.col("p.page_number").alias("page"), F.col("p.forms_detected").alias("forms"),
                          F.posexplode("p.tables").alias("tbl", "t"))
    return tables.select(*keys, "page", "forms", "tbl", F.posexplode("t").alias("r", "cells")).withColumn("r", F.col("r").cast("bigint"))


def cell_rows(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, page, tbl, r, c, text: the long form, for work that needs single cells."""
    return rows.select(*keys, "page", "tbl", "r", F.posexplode("cells").alias("c", "text"))


def nest(rows: DataFrame, company: str) -> DataFrame:
    """Table rows back to filing documents; a document is one record and as large as one filing.

    The rows of a document meet once; tables and pages are put together where they are.
    """
    rows = rows.repartition(company)
    table = F.transform(F.sort_array(F.collect_list(F.struct("r", "cells"))), lambda x: x["cells"])
    tables = rows.groupBy(company, "page", "tbl").agg(table.alias("t"))
    pages = tables.groupBy(company, "page").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("tbl", "t"))), lambda x: x["t"]).alias("tables"))
    page = F.struct(
        F.col("page").alias("page_number"), F.array(F.lit("NL-1")).alias("forms_detected"), "tables", F.lit("FORM NL-1-B-RA").alias("text"))
    return pages.groupBy(company).agg(F.sort_array(F.collect_list(page)).alias("pages"))

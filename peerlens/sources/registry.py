"""Source registry and the files that exist for a period."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import download_name, slug
from ..schemas import SOURCE_ENTRY

_MAP = T.MapType(T.StringType(), SOURCE_ENTRY)


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object name -> settings as rows: name, slug, file_name, url, file_type, url_template."""
    return explode_sources(spark.read.text(path, wholetext=True), "value")


def explode_sources(df: DataFrame, column: str) -> DataFrame:
    entries = df.select(F.explode(F.map_entries(F.from_json(F.col(column), _MAP))).alias("e"))
    name, kind = F.col("e.key"), F.coalesce(F.col("e.value.file_type"), F.lit("pdf"))
    return entries.select(
        name.alias("name"), slug(name).alias("slug"),
        F.when(kind == "xlsx", download_name(name, "xlsx")).otherwise(download_name(name)).alias("file_name"),
        "e.value.url", kind.alias("file_type"), "e.value.url_template",
    )


def availability(expected: DataFrame, files: DataFrame) -> DataFrame:
    """Expected files with a found flag; `files` lists file_name."""
    have = files.select("file_name").distinct().withColumn("_f", F.lit(True))
    return expected.join(have, "file_name", "left").withColumn("found", F.coalesce("_f", F.lit(False))).drop("_f")


def listed_files(spark: SparkSession, folder: str) -> DataFrame:
    """Names and sizes of the files of a folder; contents are not read."""
    files = spark.read.format("binaryFile").load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), "length")


def short_keys(sources: DataFrame, entities: DataFrame, name: str = "name") -> DataFrame:
    """Sources with short_key and entity_slug: the two ways of naming an entity meet at the file its document is saved as.

    entities: short_key, file_name.  Where two keys share a file the first in order counts; a source without a document of
    its own has no short key, and its slug is made of its own name.
    """
    first = entities.groupBy(F.col("file_name").alias("_file")).agg(F.min("short_key").alias("short_key"))
    met = sources.withColumn("_file", download_name(F.col(name))).join(first, "_file", "left").drop("_file")
    return met.withColumn("entity_slug", slug(F.coalesce("short_key", name)))

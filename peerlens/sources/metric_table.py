"""Reading and writing the metric table, its snapshots and its provenance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import to_double
from ..functions.periods import period_column, period_from_path
from ..schemas import METRIC_ROW


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """Metric rows of a snapshot folder; period and run_ts come back as partition columns."""
    return numbered_slides(spark.read.parquet(path))


def numbered_slides(df: DataFrame) -> DataFrame:
    """Rows whose slide is a whole number."""
    return df.withColumn("slide", F.col("slide").cast("string").try_cast("int")).where(F.col("slide").isNotNull())


def numeric_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Value columns as numbers: whatever is no plain number is null."""
    return df.withColumns({c: to_double(F.trim(F.col(c).cast("string"))) for c in columns})


def without_provenance(df: DataFrame, columns: Sequence[str] = ("source_tab", "source_link")) -> DataFrame:
    """The rows without the columns that only say where they came from."""
    return df.drop(*columns)


def read_rows_csv(spark: SparkSession, path: str) -> DataFrame:
    """The same table from CSV, slide read as text so that other rows can be told apart."""
    schema = ", ".join(f"{f.name} {'string' if f.name == 'slide' else f.dataType.simpleString()}" for f in METRIC_ROW)
    return numbered_slides(spark.read.schema(schema).option("header", True).csv(path))


def write_snapshot(df: DataFrame, path: str, run_ts: Column) -> None:
    """Appends a new snapshot; earlier ones stay, whatever the period."""
    stamped = df.withColumns({"period": period_column(F.col("fy"), F.col("q")), "run_ts": run_ts})
    stamped.write.mode("append").partitionBy("period", "run_ts").parquet(path)


def newest(df: DataFrame, by: Sequence[str], path: str = "path", run_ts: str = "run_ts") -> DataFrame:
    """Newest snapshot per period."""
    return df.groupBy(*by).agg(F.max_by(path, run_ts).alias(path), F.max(run_ts).alias(run_ts))


def snapshot_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, fy, quarter, run_ts of every file whose name states its period; contents are not read."""
    files = spark.read.format("binaryFile").load(folder).select("path")
    return with_period(files).where(F.col("fy").isNotNull())


def with_period(files: DataFrame, path: str = "path") -> DataFrame:
    return files.withColumn("_p", period_from_path(F.col(path))).select(*files.columns, "_p.*")


def newest_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the newest snapshot of every period in a snapshot folder."""
    rows = spark.read.parquet(path)
    last = rows.groupBy("period").agg(F.max("run_ts").alias("run_ts"))
    return rows.join(last, ["period", "run_ts"], "left_semi")


def clear_values(df: DataFrame) -> DataFrame:
    """Both periods and growth of populated rows set to null; keys stay."""
    populated = F.coalesce(F.col("slide").cast("string"), F.col("category")).isNotNull()
    return df.withColumns({c: F.when(~populated, F.col(c)) for c in ("cur", "prior", "growth")})


def cleared_cells(df: DataFrame) -> DataFrame:
    """How many cells clear_values empties, per slide."""
    return df.groupBy("slide").agg(
        (F.count("cur") + F.count("prior") + F.count("growth")).alias("cleared"))


def label_periods(df: DataFrame, cur_label: str, prior_label: str) -> DataFrame:
    """Neutral value columns under the names of their periods, for export."""
    return df.withColumnsRenamed({"cur": cur_label, "prior": prior_label})


def changed_labels(stored: DataFrame, old: str, new: str) -> DataFrame:
    """Label pairs that a re-label changes."""
    return stored.where(~F.col(old).eqNullSafe(F.col(new))).select(old, new).distinct()


def provenance(values: DataFrame, by: Sequence[str] = ("company",)) -> DataFrame:
    """One row per filled cell: where the value came from and which rows it went to."""
    return values.select(
        *by,
        F.struct(
            "key", "source", "kind", "cur", "prior", "found", "source_form", "page_number", "evidence", "notes",
            F.array(F.struct("slide", "metric1", "metric2")).alias("target_rows"),
        ).alias("entry"),
    )


def write_provenance(entries: DataFrame, path: str) -> None:
    """JSON lines under one folder per company: entries of a company spread over as many files as needed."""
    entries.write.mode("append").partitionBy("company").json(path)

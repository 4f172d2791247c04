"""Two incremental jobs: document intake and the progress of entities.

Both use availableNow: they take what has arrived, in batches of files, and stop.  Checkpoints and
stores live in the folder the caller names, which all executors share.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.documents import changed, newest_versions, with_fingerprint


PARTS = 16  # partitions of a store


def part_of(doc: Column) -> Column:
    return F.pmod(F.xxhash64(doc), F.lit(PARTS)).cast("int")


def file_stream(spark: SparkSession, folder: str, pattern: str, schema: StructType, files_per_batch: int | None = None) -> DataFrame:
    """What arrives in the folder under a name that fits; a table that fits may be one file or a folder of part files."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    # a plain name is made a pattern too: the source takes a path without one for a folder
    named = pattern if any(c in pattern for c in "*?[{") else f"{pattern[:-1]}[{pattern[-1]}]"
    return reader.parquet(f"{folder.rstrip('/')}/{named}")


def intake(stream: DataFrame, doc: str, text: str, verdict: Column, store: str, checkpoint: str, refused: str | None = None) -> None:
    """New or changed documents that the gate lets in are added to the store, stamped with the number of their batch.

    verdict: STRUCT<ok, reason> of a row.  A replayed batch overwrites its own folder.  Of several versions in one batch
    one is kept; what the newest stored version of a document already says adds nothing.  A batch is judged and hashed
    once, into a table beside the checkpoint that everything below reads.  The store is partitioned by a hash of the
    document: a batch reads fingerprints of those partitions only that its documents fall into.  refused: where documents
    that were not let in go, with their reason.
    """
    spark = stream.sparkSession

    def take(batch: DataFrame, batch_id: int) -> None:
        here = _number(spark, store, checkpoint, batch_id)
        judged = with_fingerprint(batch.withColumn("_v", verdict), text).withColumn("part", part_of(F.col(doc)))
        judged.write.mode("overwrite").parquet(f"{checkpoint}/judged/batch={here}")
        judged = spark.read.schema(judged.schema).parquet(f"{checkpoint}/judged/batch={here}")
        fresh = newest_versions(judged.where(F.col("_v.ok")).drop("_v"), doc, "size")
        parts = [r.part for r in judged.where(F.col("_v.ok")).select("part").distinct().collect()]  # PARTS at most
        known = _read_store(spark, store, stream.schema[doc].dataType.simpleString(), doc)
        known = known.where((F.col("batch") < here) & F.col("part").isin(parts))
        fresh = changed(fresh, known, doc, "batch")
        fresh.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{store}/batch={here}")
        if refused:
            judged.where(~F.col("_v.ok")).select(*batch.columns, "_v.reason").write.mode("overwrite").parquet(f"{refused}/batch={here}")

    stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _number(spark: SparkSession, store: str, checkpoint: str, batch_id: int) -> int:
    """Number of a batch in the store: batches of a new checkpoint follow those that the store has from others."""
    context = spark.sparkContext._jvm.org.apache.hadoop.fs
    path = context.Path(f"{checkpoint}/first-batch")
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(path):
        top = context.Path(store)
        taken = [s.getPath().getName() for s in files.listStatus(top)] if files.exists(top) else []
        first = 1 + max([int(n.split("=")[1]) for n in taken if n.startswith("batch=")], default=-1)
        spark.range(first, first + 1, 1, 1).write.parquet(f"{checkpoint}/first-batch")
    return spark.read.parquet(f"{checkpoint}/first-batch").first()[0] + batch_id


def _read_store(spark: SparkSession, path: str, doc_type: str, doc: str) -> DataFrame:
    """Fingerprints of the store; no rows where there is none yet."""
    schema = f"{doc} {doc_type}, sha256 string, size int, batch long, part int"
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def newest_intake(spark: SparkSession, store: str, doc: str) -> DataFrame:
    """The newest stored version of every document; no rows where none has been let in yet."""
    try:
        stored = spark.read.parquet(store)
    except AnalysisException as e:
        if e.getCondition() not in ("UNABLE_TO_INFER_SCHEMA", "PATH_NOT_FOUND"):
            raise
        stored = _read_store(spark, store, "string", doc)
    return newest_versions(stored, doc, "batch").drop("batch", "part")


def fold_columns(progress: str, status: str, time: str, tie: str) -> list[Column]:
    """Highest progress ever seen and the latest status."""
    latest = F.struct(F.col(time), F.col(tie))
    return [F.max(progress).alias("progress"), F.max_by(status, latest).alias("status"), F.max(latest).alias("seen")]


def progress_fold(stream: DataFrame, entity: str, progress: str, status: str, time: str, tie: str, store: str, checkpoint: str) -> None:
    """Keyed state per entity; every batch appends the entities it changed, stamped with its number."""
    state = stream.groupBy(entity).agg(*fold_columns(progress, status, time, tie))

    def put(batch: DataFrame, batch_id: int) -> None:
        # a replayed batch overwrites its own folder
        batch.write.mode("overwrite").parquet(f"{store}/batch={batch_id}")

    state.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start().awaitTermination()


def current_progress(spark: SparkSession, store: str, entity: str) -> DataFrame:
    """The newest state of every entity."""
    rows = spark.read.parquet(store)
    return rows.groupBy(entity).agg(F.max_by(F.struct("progress", "status"), "batch").alias("s")).select(entity, "s.*")

"""Session for local runs and tests; on a cluster the caller's session is used as it is."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "peerlens") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("PEERLENS_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


_shipped: set[str] = set()
_written: dict[str, list[str]] = {}


ARROW_ROWS = 2000  # rows of an Arrow batch; whole texts are wide, and a worker holds a batch at a time


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once per application, so that they need no path of the driver's.

    Lowers the rows of an Arrow batch, unless the session has a number of its own.
    """
    context, rows = spark.sparkContext, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(rows) == "10000":
        spark.conf.set(rows, str(ARROW_ROWS))
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="peerlens-code-"), "peerlens.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, files in os.walk(package):
            for name in files:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(package)))
    context.addPyFile(archive)


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the cluster's checkpoint folder, else a local one for tests."""
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="peerlens-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def written_table(df: DataFrame, name: str) -> DataFrame:
    """The rows as a parquet table in the shared folder, read back.

    Cuts the lineage where a result is used several times, survives the loss of executors and lets
    each reader fetch only the columns it needs.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/peerlens/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written_tables(spark: SparkSession) -> int:
    """Removes what written_table has stored for this application, once no result that reads it is needed any more."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        folder = hadoop.Path(path)
        folder.getFileSystem(conf).delete(folder, True)
    return len(paths)

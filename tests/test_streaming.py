"""Incremental jobs: several batches give the batch result, replays add nothing."""

import os
import shutil

from pyspark.sql import functions as F

from peerlens.streaming import jobs


def test_intake_twice_and_changed(spark, tmp_path):
    src, store = str(tmp_path / "in"), str(tmp_path / "store")
    schema = "doc int, text string"
    spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], schema).coalesce(1).write.parquet(src)
    bad = F.col("text") == "bad"
    gate = F.struct((~bad).alias("ok"), F.when(bad, "bad text").alias("reason"))

    def run(checkpoint):
        stream = jobs.file_stream(spark, src, "*.parquet", spark.read.parquet(src).schema, 1)
        jobs.intake(stream, "doc", "text", gate, store, str(tmp_path / checkpoint), str(tmp_path / "refused"))
        return sorted((r.doc, r.text) for r in spark.read.parquet(store).collect())

    def add(*rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(src)

    assert run("c1") == [(1, "a"), (2, "b")]
    assert run("c1") == [(1, "a"), (2, "b")]
    assert run("c2") == [(1, "a"), (2, "b")]
    add((1, "a"), (2, "b2"), (3, "bad"))
    assert run("c1") == [(1, "a"), (2, "b"), (2, "b2")]
    assert [(r.doc, r.reason) for r in spark.read.parquet(str(tmp_path / "refused")).collect()] == [(3, "bad text")]
    newest = lambda: sorted((r.doc, r.text) for r in jobs.newest_intake(spark, store, "doc").collect())
    assert newest() == [(1, "a"), (2, "b2")]
    add((2, "b"))  # put back to the first version
    assert run("c1") == [(1, "a"), (2, "b"), (2, "b"), (2, "b2")] and newest() == [(1, "a"), (2, "b")]


def test_a_batch_reads_its_own_partitions(spark, tmp_path):
    src, store = str(tmp_path / "in"), str(tmp_path / "store")
    spark.createDataFrame([(k, "x") for k in range(200)], "doc int, text string").coalesce(1).write.parquet(src)
    gate = F.struct((F.col("text") != "bad").alias("ok"), F.lit("bad text").alias("reason"))
    stream = lambda: jobs.file_stream(spark, src, "*.parquet", spark.read.parquet(src).schema, 1)
    jobs.intake(stream(), "doc", "text", gate, store, str(tmp_path / "c"))
    stored = spark.read.parquet(store)
    assert stored.where(F.col("part") != jobs.part_of(F.col("doc"))).isEmpty() and stored.select("part").distinct().count() == jobs.PARTS
    known = jobs._read_store(spark, store, "int", "doc").where(F.col("part").isin([3, 5]))
    plan = known._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "part" in plan.split("PartitionFilters")[1][:80] and 0 < known.count() < 200


def test_nothing_let_in(spark, tmp_path):
    src, store = str(tmp_path / "in"), str(tmp_path / "store")
    spark.createDataFrame([(1, "bad")], "doc int, text string").write.parquet(src)
    gate = F.struct(F.lit(False).alias("ok"), F.lit("bad text").alias("reason"))
    jobs.intake(jobs.file_stream(spark, src, "*.parquet", spark.read.parquet(src).schema), "doc", "text", gate, store, str(tmp_path / "c"))
    assert jobs.newest_intake(spark, store, "doc").isEmpty()


def test_progress_in_batches(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    src = str(tmp_path / "events")
    events.repartition(3).write.parquet(src)
    stream = jobs.file_stream(spark, src, "*.parquet", events.schema, 1)
    jobs.progress_fold(stream, "user_id", "value", "event_type", "ts", "event_id", str(tmp_path / "s"), str(tmp_path / "c"))
    got = {r.user_id: (r.progress, r.status) for r in jobs.current_progress(spark, str(tmp_path / "s"), "user_id").collect()}
    want = events.groupBy("user_id").agg(*jobs.fold_columns("value", "event_type", "ts", "event_id"))
    assert got == {r.user_id: (r.progress, r.status) for r in want.collect()}


def test_table_of_part_files(spark, tmp_path):
    # a table may be one file or a folder of part files, beside other tables
    src, plain = str(tmp_path / "in"), str(tmp_path / "plain")
    spark.range(6).withColumn("text", F.lit("x")).repartition(3).write.parquet(f"{src}/documents.parquet")
    spark.range(2).write.parquet(f"{src}/other.parquet")
    os.mkdir(plain)
    spark.range(4).withColumn("text", F.lit("x")).coalesce(1).write.parquet(f"{src}/one")
    part = next(f for f in os.listdir(f"{src}/one") if f.startswith("part-"))
    shutil.copy(f"{src}/one/{part}", f"{plain}/documents.parquet")
    schema = spark.read.parquet(f"{src}/documents.parquet").schema
    gate = F.struct(F.lit(True).alias("ok"), F.lit(None).cast("string").alias("reason"))
    for folder, rows in ((src, 6), (plain, 4)):
        store = f"{folder}/store"
        jobs.intake(jobs.file_stream(spark, folder, "documents.parquet", schema), "id", "text", gate, store, f"{folder}/c")
        assert jobs.newest_intake(spark, store, "id").count() == rows
    assert jobs.newest_intake(spark, str(tmp_path / "nothing"), "doc").isEmpty()

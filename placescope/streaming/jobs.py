"""Structured Streaming jobs: log ingest, incremental scoring, live counts.

All jobs run with ``availableNow``: they take what has arrived, commit, and stop, so a scheduled
rerun continues from the checkpoint.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from placescope.operators import spatial
from placescope.operators.joins import first_per_key
from placescope.sources import store


def read_log(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int = 8) -> DataFrame:
    """Stream of log files landing in a folder; timestamps become zone-aware for watermarks."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def _run(writer, checkpoint: str) -> None:
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def _batches(stream: DataFrame, checkpoint: str, step: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    _run(stream.writeStream.outputMode(mode).foreachBatch(step), checkpoint)


def _run_id(spark: SparkSession, checkpoint: str) -> str:
    """Name of the run that a checkpoint belongs to, kept beside it: a fresh checkpoint is a new run.

    Batch numbers start anew with a fresh checkpoint; the run keeps its batches apart from stored ones.
    """
    path = f"{checkpoint}-run"
    if not store.path_exists(spark, f"{path}/_SUCCESS"):
        spark.createDataFrame([(uuid.uuid4().hex,)], "run string").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path).first()["run"]


def _earlier(spark: SparkSession, base: str, run: str, batch: int, schema: StructType) -> DataFrame:
    """Rows written before this batch; its own output of a failed try is not seen."""
    if not store.path_exists(spark, f"{base}/*=*"):
        return spark.createDataFrame([], schema)
    read = spark.read.schema(StructType(list(schema.fields)).add("run", "string").add("batch", "long")).parquet(base)
    return read.where(~((F.col("run") == run) & (F.col("batch") >= batch))).drop("run", "batch")


def _store(rows: DataFrame, base: str, run: str, batch: int, by: Sequence[str] = ()) -> None:
    """Write a batch to folders of its own; a replay replaces exactly these."""
    named = rows.withColumns({"run": F.lit(run), "batch": F.lit(batch).cast("long")})
    named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by, "run", "batch").parquet(base)


def ingest_log(stream: DataFrame, base: str, checkpoint: str, unique: Sequence[str], order: str) -> None:
    """Append events whose unique key is new, however late they arrive.

    ``unique`` includes the timestamp ``ts``, so a repeat falls on the same day: the log is stored by
    day first and a batch is compared with the days between its first and last one. Below a day each
    run and batch has a folder, so a replayed batch overwrites its own half-written output. A
    watermark instead would forget old keys and drop late events.
    """
    if "ts" not in unique:
        raise ValueError("the unique key must contain ts")

    run = _run_id(stream.sparkSession, checkpoint)

    def step(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("day", F.to_date("ts")).persist()
        first, last = rows.agg(F.min("day"), F.max("day")).first()
        known = _earlier(batch.sparkSession, base, run, number, rows.schema).where(F.col("day").between(F.lit(first), F.lit(last)))
        once = first_per_key(rows, list(unique), F.col(order)).select(*rows.columns)
        fresh = once.join(known.select(*unique), list(unique), "left_anti")
        _store(fresh, base, run, number, ["day"])
        rows.unpersist()

    _batches(stream, checkpoint, step)


def dedup_recent(stream: DataFrame, unique: Sequence[str], delay: str) -> DataFrame:
    """Drop repeats that arrive within the delay, with state bounded by it."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(list(unique))


def append_parquet(stream: DataFrame, path: str, checkpoint: str) -> None:
    _run(stream.writeStream.outputMode("append").format("parquet").option("path", path), checkpoint)


def enrich(
    stream: DataFrame,
    trusted: DataFrame,
    key: str,
    ref_key: str,
    values: Sequence[str],
    base: str,
    checkpoint: str,
    k: int = 5,
) -> None:
    """Score each new keyed point once from its nearest trusted points; the first write wins."""
    run = _run_id(stream.sparkSession, checkpoint)

    def step(batch: DataFrame, number: int) -> None:
        points = batch.select(key, "lat", "lng")
        points = first_per_key(points, [key], F.struct("lat", "lng"))
        schema = StructType([points.schema[key]])
        known = _earlier(batch.sparkSession, base, run, number, schema)
        new = points.join(known, key, "left_anti")
        near = spatial.knn(new, trusted, key, ref_key, k, list(values))
        scored = new.join(spatial.idw(near, key, list(values)), key)
        _store(scored, base, run, number)

    _batches(stream, checkpoint, step)


def live_counts(stream: DataFrame, by: str, base: str, checkpoint: str) -> None:
    """Counts per label over everything seen so far, a new table version per batch."""
    counts = stream.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    _batches(counts, checkpoint, lambda df, _: store.commit(df, base) and None, mode="complete")


def stored(spark: SparkSession, base: str) -> DataFrame:
    return spark.read.parquet(base)


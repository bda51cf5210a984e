"""Versioned table folders and exports."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or glob has at least one entry, on whatever file system it names."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(hadoop)
    return found is not None and len(found) > 0


def _versions(spark: SparkSession, base: str) -> list[int]:
    """Numbers of the completely written versions."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/v*/_SUCCESS")
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(hadoop) or []
    return sorted(int(f.getPath().getParent().getName()[1:]) for f in found)


def read_current(spark: SparkSession, base: str) -> DataFrame | None:
    """The newest complete version, or None before the first commit."""
    versions = _versions(spark, base)
    return spark.read.parquet(f"{base}/v{versions[-1]:06d}") if versions else None


class VersionTaken(RuntimeError):
    """Another writer has claimed the next version; read again and redo the change."""


def _claim(spark: SparkSession, path: str) -> None:
    """Create the claim file of a version folder, which only one writer can do."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_claim")
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).createNewFile(hadoop):
        raise VersionTaken(f"{path} is claimed; if its writer is dead, remove the folder")


def commit(df: DataFrame, base: str) -> DataFrame:
    """Write ``df`` as the next version and return it as read back.

    A plan that reads the current version can be committed safely: it writes to a new folder, and
    a failed write leaves no success marker, so readers stay on the old version. Of two writers that
    start from the same version one gets ``VersionTaken``; see ``update``.
    """
    spark = df.sparkSession
    versions = _versions(spark, base)
    path = f"{base}/v{(versions[-1] if versions else 0) + 1:06d}"
    _claim(spark, path)
    df.write.mode("append").parquet(path)
    return spark.read.parquet(path)


def update(spark: SparkSession, base: str, change: Callable[[DataFrame | None], DataFrame], tries: int = 5) -> DataFrame:
    """Commit ``change`` of the current version, again from the newer one if another writer was first."""
    for left in range(tries - 1, -1, -1):
        try:
            return commit(change(read_current(spark, base)), base)
        except VersionTaken:
            if not left:
                raise
            time.sleep(1)
    raise ValueError("tries must be positive")


def export_csv(df: DataFrame, path: str, columns: Sequence[str], order: Sequence[Column]) -> None:
    """Sorted CSV parts with a header and a fixed column order; part order is row order."""
    df.select(*columns).orderBy(*order).write.mode("overwrite").option("header", True).csv(path)


def export_json(df: DataFrame, path: str, columns: Sequence[str], order: Sequence[Column], source: str) -> None:
    """Sorted JSON lines plus a one-row envelope with count and source next to them.

    The envelope is a sidecar because rows of any number must not be gathered in one document.
    """
    df.select(*columns).orderBy(*order).write.mode("overwrite").json(f"{path}/rows")
    envelope = df.agg(F.count(F.lit(1)).alias("count")).withColumn("source", F.lit(source))
    envelope.write.mode("overwrite").json(f"{path}/envelope")

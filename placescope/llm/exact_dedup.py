"""Operator 8: exact dedup against a persistent digest index. DataFrame functions only."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placescope.llm.arrow import narrow
from placescope.session import fresh_path, materialize

#: A run of these counts as one space.
WHITE = r"[\x20\x09-\x0D]+"
#: Buckets of a new index.
BUCKETS = 64


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


class DigestIndex:
    """One row per known text: its SHA-256, the id that stays and the batch that brought it.

    The table is bucketed and sorted by the digest, so that a new batch meets it in a sort-merge
    anti-join for which only the batch is shuffled. Appending adds sorted files to each bucket; with
    several of them a bucket is sorted again when it is read, until ``compacted`` makes one of them.
    Buckets are fixed when the index is made: take about one per 128 MB of digests expected. An index at
    a ``path`` that an earlier session made is opened with the buckets noted there.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None) -> None:
        self.spark = spark
        self.path = path or fresh_path(spark, "digest-index")
        note = f"{self.path.rstrip('/')}.buckets"
        known = self._noted(note) if path else None
        if known is not None and buckets not in (None, known):
            raise ValueError(f"the index at {self.path} has {known} buckets, not {buckets}")
        self.buckets = known or buckets or BUCKETS
        if known is None:
            spark.range(1).select(F.lit(self.buckets).alias("buckets")).write.parquet(note)
        self.table = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.table} (text_sha256 STRING, keep_id BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (text_sha256) SORTED BY (text_sha256) INTO {self.buckets} BUCKETS LOCATION '{self.path}'"
        )

    def _noted(self, note: str) -> int | None:
        try:
            return self.spark.read.parquet(note).first()["buckets"]
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return None
            raise

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def _append(self, rows: DataFrame) -> None:
        # By the bucket's number, so that a bucket gets one file however many partitions there are.
        bucket = F.pmod(F.hash("text_sha256"), F.lit(self.buckets))
        rows.repartition(self.buckets, bucket).sortWithinPartitions(bucket, "text_sha256").write.insertInto(self.table)
        self.spark.catalog.refreshTable(self.table)

    def compacted(self, path: str | None = None, buckets: int | None = None) -> DigestIndex:
        """The same rows as a new index with one file per bucket; this one stays as it is."""
        out = DigestIndex(self.spark, path, buckets or self.buckets)
        out._append(self.rows().select("text_sha256", "keep_id", "batch"))
        return out

    def close(self) -> None:
        """Forget the table's name; its files stay and can be opened again by their path."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    def digests(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """doc_id, row number and digest of every row, written once; the texts are not read again."""
        d = narrow(docs, id_col, text_col)
        return materialize(
            d.select("doc_id", F.monotonically_increasing_id().alias("row"), F.sha2(normalised(F.col("text")).cast("binary"), 256).alias("text_sha256")),
            "digests",
        )

    def ingest(self, docs: DataFrame, batch: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Append the batch's new texts; return doc_id, keep_id, group_size, kept, text_sha256 of each row.

        Equal texts are those with the same normalised form; null counts as empty, and empty texts
        equal one another. The smallest id of the batch stays (a null id only if there is no other),
        and of rows that share it exactly one. A text that an earlier batch brought keeps the id stored
        then, and no row of this batch stays. ``group_size`` counts rows of this batch. An empty batch
        appends nothing and returns no rows. Other columns of ``docs`` are ignored.

        A job that died is run again with the rows and the ``batch`` it had: what it appended under that
        name counts as new, and only what is missing is appended. Without a name each call is a batch.
        """
        batch = batch or uuid.uuid4().hex
        rows = self.digests(docs, id_col, text_col)
        groups = materialize(
            rows.groupBy("text_sha256").agg(
                F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("first"), F.count(F.lit(1)).alias("group_size")
            ),
            "digest-groups",
        )
        new = groups.join(self.rows().select("text_sha256").hint("merge"), "text_sha256", "left_anti")
        self._append(new.select("text_sha256", F.col("first.doc_id").alias("keep_id"), F.lit(batch).alias("batch")))
        known = groups.join(self.rows().hint("merge"), "text_sha256").select("text_sha256", "keep_id", "group_size", "batch", F.col("first.row").alias("first_row"))
        return rows.join(known, "text_sha256").select(
            "doc_id", "keep_id", "group_size", ((F.col("batch") == batch) & (F.col("row") == F.col("first_row"))).alias("kept"), "text_sha256"
        )

    def new_rows(self, docs: DataFrame, batch: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Ingest ``docs`` and return its rows that stay, all columns unchanged.

        Of rows that share the id as well as the normalised text any one stays.
        """
        kept = self.ingest(docs, batch, id_col, text_col).filter("kept").select(F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("no_id"), F.col("text_sha256").alias("sha"))
        own = docs.select(
            F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("own"), F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("id"), F.col(id_col).isNull().alias("no_id"),
            F.sha2(normalised(F.col(text_col).cast("string")).cast("binary"), 256).alias("sha"),
        )
        keys = ["sha", "id", "no_id"]
        return own.join(kept, keys, "left_semi").dropDuplicates(keys).select("own.*")


ORACLE = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""

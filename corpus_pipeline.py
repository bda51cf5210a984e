"""A corpus pipeline of five stages, each written as Parquet and reread as the next one's documents.

Language rejection, exact dedup, near dedup and repeat removal return the columns of ``documents``; the
last stage returns the pieces of the packed sequences. Ids are taken to be unique, as in ``documents``.
Columns of any name are carried. A null or empty text, having no letter, goes at the first stage. Rows with
a null id are judged like others; of near-duplicates without any id all stay. An empty table passes through
every stage as an empty table.

Unless the session sets ``spark.sql.execution.arrow.maxBytesPerBatch``, the stages set it to ``BATCH_BYTES``:
what a task holds outside the heap and in its Python worker is a few batches.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placescope.llm import exact_dedup, language_id, minhash, packing, suffix_dedup
from placescope.session import materialize

BATCH_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "2m"

#: Language models and rejection limits are learned from the rows themselves; no SQL says that.
ORACLE_SQL = None


def bounded_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of the session by bytes, where its user has not."""
    if spark.conf.get(BATCH_KEY, None) is None:
        spark.conf.set(BATCH_KEY, BATCH_BYTES)


def accept_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text some language model accepts. Rows without a lang are judged but not learned from."""
    bounded_batches(spark)
    model = language_id.fit(docs.select("text", "lang"))
    return language_id.accepted(docs, model, language_id.calibrate(docs, model))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that of the smallest id, of texts that are equal but for white space."""
    bounded_batches(spark)
    return exact_dedup.DigestIndex(spark).new_rows(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that of the smallest id, of each component of near-duplicates."""
    bounded_batches(spark)
    kept = minhash.near_duplicates(docs).filter("kept").select("doc_id")
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("own"), F.col("doc_id").alias("id"))
    return own.join(kept, F.col("id").eqNullSafe(F.col("doc_id")), "left_semi").select("own.*")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without the byte strings of 200 and more that occur more than once; n_chars follows."""
    bounded_batches(spark)
    return suffix_dedup.cleaned(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens with their sequence and offset."""
    bounded_batches(spark)
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"), text_bytes=1 << 20)


STAGES = [
    ("language_id", accept_language),
    ("exact_dedup", drop_copies),
    ("minhash_near_dedup", drop_near_copies),
    ("suffix_dedup", cut_repeats),
    ("best_fit_packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""The registered query of each operator, over whole tables with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placescope.llm import bpe, exact_dedup, hard_negatives, language_id, lexical_search, license_scan, minhash, packing, pii, quality, suffix_dedup, toxicity, warc
from placescope.plans.catalog import Catalog

CATALOG = Catalog()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@CATALOG.query("op1_best_fit_packing")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


@CATALOG.query("op2_minhash_near_dedup", minhash.ORACLE)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir))


@CATALOG.query("op3_byte_bpe")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@CATALOG.query("op4_suffix_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removal_digests(documents(spark, sf_dir))


@CATALOG.query("op5_quality_rules", quality.ORACLE)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.cascade(documents(spark, sf_dir)).drop("rejected_by")


@CATALOG.query("op6_warc", warc.ORACLE)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return warc.resolved(warc.read_archives(archives))


@CATALOG.query("op7_toxicity")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.held_out_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@CATALOG.query("op8_exact_dedup", exact_dedup.ORACLE)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.DigestIndex(spark).ingest(documents(spark, sf_dir))


@CATALOG.query("op9_language_id")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.held_out_prediction(documents(spark, sf_dir))


@CATALOG.query("op10_license_scan")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir))


@CATALOG.query("op11_hard_negatives", hard_negatives.ORACLE)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), label=label)


@CATALOG.query("op12_lexical_search", lexical_search.ORACLE)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@CATALOG.query("op13_pii")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.find_spans(documents(spark, sf_dir)))

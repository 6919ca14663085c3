"""The registered queries of the training-data operators: thin, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe_stream import bpe_round_trip
from .common import vocab_path
from .fill_middle import ORACLE as FILL_MIDDLE_SQL
from .fill_middle import fill_in_middle_digest
from .hard_negatives import ORACLE as NEGATIVES_SQL
from .hard_negatives import hard_negatives
from .language_id import language_id
from .license_scan import license_scan
from .line_dedup import ORACLE as LINE_DEDUP_SQL
from .line_dedup import line_dedup
from .near_dedup import near_duplicates
from .order_minhash import order_minhash
from .packing import pack_documents
from .quality import quality_rules
from .token_count import token_counts
from .token_store import token_store_digest
from .warc import ORACLE as WARC_SQL
from .warc import warc_round_trip


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_documents(spark, sf_dir), vocab_path("word_bpe_49k.json"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(_documents(spark, sf_dir)).drop("spans")


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(_documents(spark, sf_dir), vocab_path("word_bpe_49k.json"))


def op4_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash(_documents(spark, sf_dir), k=3, parts=32, keep=2)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"), min_bytes=1000)


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store_digest(_documents(spark, sf_dir), vocab_path("word_bpe_49k.json"), end_id=1)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(_documents(spark, sf_dir).select("doc_id", "text"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_documents(spark, sf_dir), vocab_path("byte_bpe_50k.json"), capacity=2048, end_id=0)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_documents(spark, sf_dir), words=5, percent=75)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0, positives=5, negatives=10, label=label)


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle_digest(_documents(spark, sf_dir), seed=7, fim_percent=100, spm_percent=50, units="lines")


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(_documents(spark, sf_dir)).drop("spans")


_QUERIES = (
    op1_token_counts,
    op2_license_scan,
    op3_bpe_round_trip,
    op4_order_minhash,
    op5_warc,
    op6_token_store,
    op7_line_dedup,
    op8_best_fit_packing,
    op9_quality_rules,
    op10_minhash_near_dedup,
    op11_hard_negatives,
    op12_fill_middle,
    op13_language_id,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op5_warc": WARC_SQL, "op7_line_dedup": LINE_DEDUP_SQL, "op11_hard_negatives": NEGATIVES_SQL, "op12_fill_middle": FILL_MIDDLE_SQL}

"""Corpus pipeline: quality rules, line dedup, near-duplicate removal, packing into training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.llm.common import drop_dirs, materialize, scratch_scope, vocab_path
from strataloom.llm.line_dedup import line_dedup
from strataloom.llm.near_dedup import near_duplicates
from strataloom.llm.packing import pack_documents
from strataloom.llm.quality import fit_line_field, quality_filter


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the line field reject go; the rest stay as they are.

    Null and empty texts have too few words and go. Repeated rows and null ids are judged by their text like all others;
    columns stay as they are, whatever their names; an empty table stays empty.
    """
    field = fit_line_field(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_filter(docs, field)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated three-line windows go from all but their first place; ``n_chars`` follows the text.

    Null texts become empty ones, repeated rows stay alike, null ids come first; an empty table stays empty. The counts of
    the operator are not handed on, and no column of ``docs`` is lost.
    """
    counts = {c: f"__{c}" for c in ("n_lines", "n_removed") if c in docs.columns}
    clean = line_dedup(docs.withColumnsRenamed(counts)).drop("n_lines", "n_removed").withColumnsRenamed({v: k for k, v in counts.items()})
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.char_length("text")).cast(docs.schema["n_chars"].dataType))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates stays, that with the least id.

    An id names a document: rows that repeat it stay or go together. Rows without an id, or without words, stay. Columns
    stay as they are, whatever their names; an empty table stays empty.
    """
    gone = near_duplicates(docs).where("NOT kept").select(F.col("doc_id").alias("__gone_id")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["__gone_id"], "left_anti")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes in the training sequences; all rows are packed, those without an id or text too.

    Repeated rows are packed as often as they come; long texts are cut into pieces. Other columns are not read, whatever their
    names; an empty table gives no pieces.
    """
    return pack_documents(docs, vocab_path("byte_bpe_50k.json"), capacity=2048, end_id=0)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("MinHash near-dedup", near_duplicate_stage),
    ("best-fit packing", packing_stage),
]

#: Tokenizing and the line field have no SQL; tests hold each stage against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the ``documents`` table, each written to the shared folder and read again.

    What a stage leaves in the shared folder is deleted once its output, or that of the next stage, is written.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for k, (name, stage) in enumerate(STAGES):
        if k == len(STAGES) - 1:
            return stage(spark, docs, sf_dir)
        with scratch_scope() as made:
            written: list[str] = []
            docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"), written)
        drop_dirs(spark, [path for path in made if path not in written] + before)
        before = written

"""Helpers that several training-data operators share."""

from __future__ import annotations

import contextlib
import contextvars
import gc
import math
import re
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A cut before a plain blank that follows a non-blank never splits a pre-token.
_CUT = re.compile(r"(?<=\S)[ \n]")


def vocab_path(name: str) -> str:
    """Place of a public vocabulary file; the package that holds them is installed on driver and executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


def blocks(text: str, size: int = 1 << 20) -> Iterator[str]:
    """The text in pieces of about ``size`` characters, cut only where a blank follows a word."""
    at, n = 0, len(text)
    while n - at > size:
        m = _CUT.search(text, at + size)
        if not m:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:] if at else text


def text_slices(column, max_chars: int = 1 << 21) -> Iterator[list[str]]:
    """Texts of an Arrow string column in lists of about ``max_chars`` characters; null becomes the empty text."""
    held, chars = [], 0
    for v in column:
        t = v.as_py() or ""
        held.append(t)
        chars += len(t)
        if chars >= max_chars:
            yield held
            held, chars = [], 0
    if held:
        yield held


_SCOPE: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("scratch", default=None)


@contextlib.contextmanager
def scratch_scope() -> Iterator[list[str]]:
    """Collects the names of all scratch folders that are made inside.

    Operators return rows that are read from such folders when the caller asks for them; once the caller has written the
    rows, :func:`drop_dirs` on the list clears them away.
    """
    made: list[str] = []
    token = _SCOPE.set(made)
    try:
        yield made
    finally:
        _SCOPE.reset(token)


def scratch_dir(spark: SparkSession, what: str) -> str:
    """A new folder name in the shared folder that spark.checkpoint.dir names.

    Where the setting is missing (tests on one machine), a folder below the warehouse is taken.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    path = f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"
    if (made := _SCOPE.get()) is not None:
        made.append(path)
    return path


def materialize(df: DataFrame, what: str, made: list[str] | None = None) -> DataFrame:
    """Write the rows to the shared folder and read them back: cuts lineage, survives lost executors.

    The folder's name is added to ``made``, for :func:`drop_dirs` once nothing reads the rows any more.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, what)
    df.write.parquet(path)
    if made is not None:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_dirs(spark: SparkSession, made: list[str], keep: int = 0) -> None:
    """Delete written folders but the last ``keep``."""
    while len(made) > keep:
        remove_dir(spark, made.pop(0))


def remove_dir(spark: SparkSession, path: str) -> None:
    """Delete a folder through the Hadoop file system that owns it."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished steps: Spark deletes them once their plans are collected as garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def dealing_keys(spark: SparkSession, n: int) -> list[int]:
    """Integers of which the i-th goes to partition i when ``n`` partitions are dealt by the hash of an int column."""
    if n <= 1:
        return [0]
    tries = spark.range(int(n * (math.log(n) + 12))).select(F.col("id").cast("int").alias("k"))
    found = tries.groupBy(F.pmod(F.hash("k"), F.lit(n)).alias("p")).agg(F.min("k").alias("k")).collect()  # n rows at most
    at = {r.p: r.k for r in found}
    return [at.get(i, i) for i in range(n)]


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows for the jobs that run inside: rows that hold whole sets stay few in memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def id_bounds(df: DataFrame, col: str, rows_per_bucket: int, most: int = 20_000) -> list[int]:
    """Ascending upper cuts that deal the ids into buckets of about ``rows_per_bucket`` rows.

    Reads the id column only. The list has at most ``most`` entries, so its size on the driver is bounded.
    """
    ids = df.select(F.col(col).cast("long").alias("i")).where("i IS NOT NULL")
    n = ids.count()
    k = min(most, -(-n // rows_per_bucket))
    if k <= 1:
        return []
    cuts = ids.agg(F.percentile_approx("i", [j / k for j in range(1, k)], max(10_000, 10 * k)).alias("c")).first().c
    return sorted(set(cuts))


def cuts_below(cuts: list[int], col):
    """How many of the ascending cuts lie below a column: a coarse search, then one within a stretch of the cuts."""
    if not cuts:
        return F.lit(0)
    step = max(1, math.isqrt(len(cuts)))
    lits = lambda xs: F.array(*(F.lit(x).cast("long") for x in xs))
    count = lambda xs: F.size(F.filter(xs, lambda x: x < col))
    skipped = F.greatest(count(lits(cuts[::step])) - 1, F.lit(0)) * step
    return skipped + count(F.slice(lits(cuts), skipped + 1, step))

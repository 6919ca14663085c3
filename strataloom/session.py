"""Session factory with the settings the engine relies on."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "strataloom", cpus: int | None = None, **extra: str) -> SparkSession:
    """A session with UTC time, AQE and skew joins on.

    On a cluster pass nothing: master, shuffle partitions and memory come from spark-submit.
    ``cpus`` selects local mode, for tests and the bench.
    """
    b = SparkSession.builder.appName(app)
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    if cpus:
        b = b.master(f"local[{cpus}]")
        conf |= {
            "spark.sql.shuffle.partitions": str(cpus),
            "spark.driver.memory": os.environ.get("STRATALOOM_DRIVER_MEMORY", "8g"),
            "spark.driver.host": "127.0.0.1",
        }
    for k, v in (conf | extra).items():
        b = b.config(k, v)
    return b.getOrCreate()


def load_tables(spark: SparkSession, sf_dir: str, *names: str):
    """DataFrames of the named parquet tables below ``sf_dir``."""
    frames = [spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names]
    return frames[0] if len(frames) == 1 else frames


def tasks_for(df: DataFrame, bytes_each: int = 2 << 20) -> int:
    """Tasks for work on all rows of an input, given as a number where rows weigh many times their compressed bytes: as many as
    the session has shuffle partitions, and more where an input of ``bytes_each`` a task asks for them."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // bytes_each))


def spread(df: DataFrame, least_bytes: int = 2 << 20) -> DataFrame:
    """A small input dealt over all cores: one file of one row group would keep a single task busy.

    Inputs of more than ``least_bytes`` a core stay as they are, so nothing is shuffled at scale.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * least_bytes else df

"""Bundles, versioned publication and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTITY = "struct<id:string,kind:string,rank:int,parent_id:string,name:string>"
RELATION = "struct<id:string,from_id:string,to_id:string,kind:string>"
BUNDLE = f"struct<id:string,entities:array<{ENTITY}>,relations:array<{RELATION}>>"


def write_bundle(entities: DataFrame, relations: DataFrame, snapshot: str, path: str) -> None:
    """One JSON line per row in canonical order: entities by id, then relations by id. Sorted by range over many files, which are
    compressed; bodies are made of what was sorted, as they hold it again in more bytes."""
    facts = {"entity": ("id", "kind", "rank", "parent_id", "name"), "relation": ("id", "from_id", "to_id", "kind")}
    rows = entities.select(F.lit("entity").alias("fact"), *facts["entity"]).unionByName(relations.select(F.lit("relation").alias("fact"), *facts["relation"]), allowMissingColumns=True)
    body = F.when(F.col("fact") == "entity", F.to_json(F.struct(*facts["entity"]))).otherwise(F.to_json(F.struct(*facts["relation"])))
    rows.orderBy("fact", "id").select(F.lit(snapshot).alias("snapshot"), "fact", "id", body.alias("body")).write.mode("overwrite").json(path, compression="gzip")


def read_bundle(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(entities, relations) of a written bundle; the schema is given, nothing is inferred."""
    rows = spark.read.schema("snapshot string, fact string, id string, body string").option("mode", "FAILFAST").json(path)
    pick = lambda fact, kind: rows.where(F.col("fact") == fact).select("snapshot", F.from_json("body", kind).alias("x")).select("snapshot", "x.*")
    return pick("entity", ENTITY), pick("relation", RELATION)


def read_portable(files: DataFrame, most_bytes: int = 128 << 20) -> tuple[DataFrame, DataFrame]:
    """(entities, relations) of portable JSON documents (path, text); those over the limit are left out."""
    docs = files.where(F.octet_length("text") <= most_bytes).select(F.from_json("text", BUNDLE).alias("b")).where("b.id IS NOT NULL")
    pick = lambda c: docs.select(F.col("b.id").alias("snapshot"), F.explode(f"b.{c}").alias("x")).select("snapshot", "x.*")
    return pick("entities"), pick("relations")


def publish(df: DataFrame, root: str, slug: str, version: str) -> None:
    """Write an immutable version, its data first and the pointer last; readers that hold an old pointer stay right.

    A version that exists already is an error, so a half-written one is never taken for another's.
    """
    spark = df.sparkSession
    df.write.mode("errorifexists").parquet(f"{root}/data/slug={slug}/version={version}")
    spark.createDataFrame([(slug, version)], "slug string, version string").coalesce(1).write.mode("overwrite").json(f"{root}/latest/slug={slug}")


def read_latest(spark: SparkSession, root: str, slug: str) -> DataFrame:
    """The version that the pointer of a slug names; only its folder is read."""
    at = spark.read.schema("version string").json(f"{root}/latest/slug={slug}").first()
    return spark.read.parquet(f"{root}/data/slug={slug}/version={at.version}")


def write_packed(df: DataFrame, table: str, key: str, buckets: int) -> None:
    """A table bucketed and sorted by key: joins on the key need no shuffle, and a key's rows lie in one file."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(table)


def manifest(rows: DataFrame) -> DataFrame:
    """(slug, version, at): the newest version of each slug."""
    return rows.groupBy("slug").agg(F.max_by("version", F.struct("at", "version")).alias("version"), F.max("at").alias("at"))


def stress_graph(spark: SparkSession, nodes: int, edges: int, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(nodes (id, x, y), edges (id, from_id, to_id)) from a seed: every value is a hash of its number, in any partition."""
    draw = lambda what, n: F.pmod(F.xxhash64(F.lit(seed), F.lit(what), "i"), F.lit(n))
    side = max(1, int(nodes**0.5))
    i = spark.range(nodes).withColumnRenamed("id", "i")
    n = i.select(F.concat(F.lit("node-"), F.col("i").cast("string")).alias("id"), (F.col("i") % side * 100 + draw("x", 40)).alias("x"), (F.floor(F.col("i") / side) * 100 + draw("y", 40)).alias("y"))
    e = spark.range(edges).withColumnRenamed("id", "i").select(F.concat(F.lit("edge-"), F.col("i").cast("string")).alias("id"), F.concat(F.lit("node-"), draw("from", nodes).cast("string")).alias("from_id"), F.concat(F.lit("node-"), draw("to", nodes).cast("string")).alias("to_id"))
    return n, e


def sequence_diagram(steps: DataFrame, group: str, order: str, src: str, dst: str, label: str) -> DataFrame:
    """(group, text): a sequence diagram of ordered steps."""
    from ..functions.text import mermaid_id, mermaid_label

    line = F.concat(F.lit("  "), mermaid_id(F.col(src)), F.lit("->>"), mermaid_id(F.col(dst)), F.lit(": "), mermaid_label(F.col(label)))
    rows = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("t"))))
    return steps.groupBy(group).agg(F.concat(F.lit("sequenceDiagram\n"), F.array_join(F.transform(rows, lambda x: x["t"]), "\n")).alias("text"))

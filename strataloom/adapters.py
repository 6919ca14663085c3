"""Views that derive the engine's data model from the test tables.

Two containment trees: system > region > nation > customer and supplier, and catalog > brand > type > part. Relations are
the distinct customer-supplier pairs of the orders, with one piece of evidence for each line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .plans.registry import Tables


def _tree(df: DataFrame, key, kind: str, rank: int, parent, name) -> DataFrame:
    return df.select(key.alias("id"), F.lit(kind).alias("kind"), F.lit(rank).alias("rank"), parent.alias("parent_id"), name.alias("name"))


def tag(prefix: str, col: str):
    """An id: prefix and key."""
    return F.concat(F.lit(prefix), F.col(col).cast("string"))


def entities(t: Tables) -> DataFrame:
    """(id, kind, rank, parent_id, name): the geographic tree."""
    root = t.spark.range(1).select(F.lit("sys").alias("id"), F.lit("softwareSystem").alias("kind"), F.lit(0).alias("rank"), F.lit(None).cast("string").alias("parent_id"), F.lit("system").alias("name"))
    return (
        root.unionAll(_tree(t.region, tag("r", "r_regionkey"), "container", 1, F.lit("sys"), F.col("r_name")))
        .unionAll(_tree(t.nation, tag("n", "n_nationkey"), "component", 2, tag("r", "n_regionkey"), F.col("n_name")))
        .unionAll(_tree(t.customer, tag("c", "c_custkey"), "code", 3, tag("n", "c_nationkey"), F.col("c_name")))
        .unionAll(_tree(t.supplier, tag("s", "s_suppkey"), "code", 3, tag("n", "s_nationkey"), F.col("s_name")))
    )


#: The same view in DuckDB SQL.
ENTITIES = """entities AS (
 SELECT 'sys' AS id, 'softwareSystem' AS kind, 0 AS rank, NULL::VARCHAR AS parent_id, 'system' AS name
 UNION ALL SELECT 'r' || r_regionkey, 'container', 1, 'sys', r_name FROM region
 UNION ALL SELECT 'n' || n_nationkey, 'component', 2, 'r' || n_regionkey, n_name FROM nation
 UNION ALL SELECT 'c' || c_custkey, 'code', 3, 'n' || c_nationkey, c_name FROM customer
 UNION ALL SELECT 's' || s_suppkey, 'code', 3, 'n' || s_nationkey, s_name FROM supplier)"""


def order_lines(t: Tables) -> DataFrame:
    """(from_id, to_id, kind, path, line, optional, technology): one row of evidence for each order line."""
    lines = t.lineitem.select("l_orderkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus")
    orders = t.orders.select("o_orderkey", "o_custkey", "o_orderpriority")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        tag("c", "o_custkey").alias("from_id"),
        tag("s", "l_suppkey").alias("to_id"),
        F.when(F.col("l_linestatus") == "O", "uses").otherwise("calls").alias("kind"),
        tag("orders/", "l_orderkey").alias("path"),
        F.col("l_linenumber").alias("line"),
        (F.col("l_returnflag") == "R").alias("optional"),
        F.col("o_orderpriority").alias("technology"),
    )


def relations(t: Tables) -> DataFrame:
    """(id, from_id, to_id, kind, label, technology, optional, evidence): one row per pair and kind."""
    return (
        order_lines(t)
        .groupBy("from_id", "to_id", "kind")
        .agg(F.min("technology").alias("technology"), F.bool_and("optional").alias("optional"), F.count("*").alias("evidence"))
        .select(
            F.concat("from_id", F.lit(">"), "to_id", F.lit(":"), "kind").alias("id"),
            "from_id",
            "to_id",
            "kind",
            F.when(F.col("evidence") > 1, F.col("technology")).alias("label"),
            "technology",
            "optional",
            "evidence",
        )
    )


LINES = """order_lines AS (
 SELECT 'c' || o_custkey AS from_id, 's' || l_suppkey AS to_id, CASE WHEN l_linestatus = 'O' THEN 'uses' ELSE 'calls' END AS kind,
  'orders/' || l_orderkey AS path, l_linenumber AS line, l_returnflag = 'R' AS optional, o_orderpriority AS technology
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
RELATIONS = (
    LINES
    + """, relations AS (
 SELECT from_id || '>' || to_id || ':' || kind AS id, from_id, to_id, kind, CASE WHEN count(*) > 1 THEN min(technology) END AS label,
  min(technology) AS technology, bool_and(optional) AS optional, count(*) AS evidence
 FROM order_lines GROUP BY from_id, to_id, kind)"""
)
CLOSURE = """closure AS (
 WITH RECURSIVE up(id, ancestor_id, depth) AS (SELECT id, id, 0 FROM entities
  UNION ALL SELECT up.id, e.parent_id, up.depth + 1 FROM up JOIN entities e ON e.id = up.ancestor_id WHERE e.parent_id IS NOT NULL)
 SELECT * FROM up)"""
GRAPH = f"WITH {ENTITIES}, {RELATIONS}, {CLOSURE} "


def flows(t: Tables) -> DataFrame:
    """(from_id, to_id): a directed graph that grows with the tables: nation to customer to supplier to part."""
    return repeated_flows(t).distinct()


def repeated_flows(t: Tables) -> DataFrame:
    """The arcs of :func:`flows` as often as lines have them, for operators that merge repeated arcs themselves."""
    lines = t.lineitem.select("l_orderkey", "l_suppkey", "l_partkey").join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    arc = lambda a, b: F.struct(a.alias("from_id"), b.alias("to_id"))
    c, s = tag("c", "o_custkey"), tag("s", "l_suppkey")
    traded = lines.select(F.explode(F.array(arc(c, s), arc(s, tag("p", "l_partkey")))).alias("a")).select("a.*")
    return traded.unionAll(t.customer.select(tag("n", "c_nationkey").alias("from_id"), tag("c", "c_custkey").alias("to_id")))


FLOWS = """lines AS (SELECT 'c' || o_custkey AS c, 's' || l_suppkey AS s, 'p' || l_partkey AS p FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
 flows AS (SELECT c AS from_id, s AS to_id FROM lines UNION SELECT s, p FROM lines UNION SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer)"""


def dealt(df: DataFrame) -> DataFrame:
    """A table whose rows are few bytes and make much work each, dealt over all tasks: its file alone would be read by one or two."""
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism)


def script_files(t: Tables) -> DataFrame:
    """(path, text): a script for each part, with what misleads patterns: nested templates, regular expressions, comments, generics."""
    loops = F.repeat(F.lit("  for (const x of item.list) { use(x) }\n"), F.col("p_size") % 5)
    key, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    text = F.concat(
        F.lit("import { helper as h"), size, F.lit(", type Kind } from \"./brand/"), F.col("p_brand"), F.lit("\";\nimport * as all from '"), F.lower("p_type"), F.lit("'\n// import no from 'comment'\nexport function part_"), key,
        F.lit("<T extends { size: number }>(item: T, q?: number): Promise<{ ok: boolean }> {\n  const label = `size ${ q ? `in ${q}` : \""), F.col("p_name"), F.lit("\" } if (x) {`;\n  if (/[{`\"]if/.test(label) && q) { return load() }\n"),
        loops, F.lit("  return import('./lazy/"), F.col("p_brand"), F.lit("');\n}\nconst price_"), key, F.lit(" = 1.5,\n  over_"), key, F.lit(" = (a: Map<string, number>) => a.size > "), size, F.lit(" ? 1 : 2;\nclass Box_"), key, F.lit(" { get v() { return 1 } }\n"),
    )
    return dealt(t.part).select(F.concat(F.lit("parts/"), key, F.lit(".ts")).alias("path"), text.alias("text"))


def rust_files(t: Tables) -> DataFrame:
    """(path, text): a Rust file for each supplier, with lifetimes, raw strings, nested comments and test modules."""
    key = F.col("s_suppkey").cast("string")
    text = F.concat(
        F.lit("use std::{fmt, io::Read};\nuse crate_"), F.col("s_nationkey").cast("string"), F.lit("::Thing as T;\n/* fn no() { /* nested */ } */\npub struct Supplier"), key,
        F.lit("<'a> { name: &'a str }\nimpl<'a> fmt::Display for Supplier"), key, F.lit("<'a> {\n  fn fmt(&self) -> bool { self.c == '\\'' }\n}\npub(crate) fn balance_"), key,
        F.lit("() -> i64 { let r = r#\"fn raw() { \"quoted\" }\"#; 1 }\n#[cfg(test)]\nmod tests { fn t() {} }\n"),
    )
    return dealt(t.supplier).select(F.concat(F.lit("suppliers/"), key, F.lit(".rs")).alias("path"), text.alias("text"))

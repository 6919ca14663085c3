"""Sources and sinks (S): files are made from the tables, written or parsed, and read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from .. import adapters as A
from ..operators import aggregates as S
from ..operators import code_facts as C
from ..operators import ranking as K
from ..operators import validate as V
from ..operators.discovery import discover
from ..session import tasks_for
from ..sources import bundles, files
from ..sources.code_tokens import code_tokens
from .registry import Tables, query


def scratch(t: Tables) -> str:
    """A new folder in the shared folder of the session; a local one only where none is set, as in tests."""
    base = t.spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.gettempdir()}"
    return f"{base.rstrip('/')}/strataloom-{uuid.uuid4().hex}"


@query("s2_tree_read", "SELECT n_name AS name, length(n_name)::BIGINT AS size FROM nation")
def _(t):
    at = scratch(t)
    t.nation.select("n_name", F.col("n_name").alias("value")).repartition(3).write.partitionBy("n_name").text(at)
    tree = files.read_tree(t.spark, at, "*.txt", 1 << 20)
    return tree.select(F.trim(F.replace("text", F.lit("\n"), F.lit(""))).alias("name")).withColumn("size", F.length("name").cast("long"))


@query(
    "s3_chunk_plan",
    "WITH RECURSIVE d AS (SELECT source, n_chars AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents),"
    " c(source, i, chunk, used) AS (SELECT source, i, 0, n FROM d WHERE i = 1 UNION ALL SELECT d.source, d.i, CASE WHEN c.used + d.n > 50000 THEN c.chunk + 1 ELSE c.chunk END, CASE WHEN c.used + d.n > 50000 THEN d.n ELSE c.used + d.n END FROM c JOIN d ON d.source = c.source AND d.i = c.i + 1)"
    " SELECT source, chunk::INTEGER AS chunk, count(*)::BIGINT AS files FROM c GROUP BY 1, 2",
)
def _(t):
    d = t.documents.select("source", "doc_id", "n_chars").withColumn("order", F.col("doc_id"))
    return K.blob_chunks(d, "source", "order", "n_chars", "doc_id", 50_000).groupBy("source", "chunk").agg(F.count("*").alias("files"))


@query("s4_source_parse", "SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)/', 1) AS owner, regexp_extract(url, '^[a-z]+://[^/]+/([^/?#]+)', 1) AS repo FROM pages")
def _(t):
    return t.pages.select("page_id", F.regexp_extract("url", "^[a-z]+://([^/]+)/", 1).alias("owner"), F.regexp_extract("url", "^[a-z]+://[^/]+/([^/?#]+)", 1).alias("repo"))


@query(
    "s6_discovery",
    "SELECT 'repo' || (p_partkey // 40) AS repo, v.path, v.unit, v.kind, v.reason FROM part, LATERAL (VALUES ('packages/p' || p_partkey || '/src/a.ts', 'packages/p' || p_partkey, 'member', NULL), ('packages/p' || p_partkey || '/in/package.json', NULL, NULL, 'ending'),"
    " ('packages/p' || p_partkey || '/in/b.tsx', 'packages/p' || p_partkey || CASE WHEN p_partkey % 2 = 0 THEN '/in' ELSE '' END, 'member', NULL), ('packages/p' || p_partkey || '/package.json', NULL, NULL, 'ending'), ('crates/c' || p_partkey || '/Cargo.toml', NULL, NULL, 'ending'),"
    " ('crates/c' || p_partkey || '/src/lib.rs', 'crates/c' || p_partkey, 'rust', NULL), ('examples/e' || p_partkey || '/package.json', NULL, NULL, 'ending'), ('examples/e' || p_partkey || '/x.ts', NULL, NULL, 'scaffolding'), ('scripts/' || lower(p_brand) || p_partkey || '.mjs', 'tooling', 'tooling', NULL),"
    " ('packages/p' || p_partkey || '/testdata/z.ts', NULL, NULL, 'testdata'), ('packages/p' || p_partkey || '/a.test.ts', NULL, NULL, 'excluded'), ('packages/p' || p_partkey || '/plain.js', NULL, NULL, 'ending')) v(path, unit, kind, reason)"
    " UNION ALL SELECT DISTINCT 'repo' || (p_partkey // 40), 'pnpm-workspace.yaml', NULL, NULL, 'ending' FROM part",
)
def _(t):
    key, odd = F.col("p_partkey").cast("string"), F.col("p_partkey") % 2
    at = lambda *parts: F.struct(F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts)).alias("path"), F.lit(None).cast("string").alias("text"))
    made = ["/src/a.ts", "/in/b.tsx", "/package.json", "/testdata/z.ts", "/a.test.ts", "/plain.js", "/in/package.json"]
    files = [at("packages/p", key, x) for x in made] + [at("crates/c", key, "/Cargo.toml"), at("crates/c", key, "/src/lib.rs"), at("examples/e", key, "/package.json"), at("examples/e", key, "/x.ts"), at("scripts/", F.lower("p_brand"), key, ".mjs")]
    repo = F.concat(F.lit("repo"), F.floor(F.col("p_partkey") / 40).cast("string")).alias("repo")
    rows = A.dealt(t.part).select(repo, F.explode(F.array(*files)).alias("f")).select("repo", "f.*")
    # Each repository's workspace file lists the inner packages of even parts by name.
    inner = F.concat(F.lit("  - packages/p"), key, F.lit("/in\n"))
    listed = t.part.groupBy(repo).agg(F.array_join(F.sort_array(F.collect_list(F.when(odd == 0, inner))), "").alias("l"))
    spaces = listed.select("repo", F.lit("pnpm-workspace.yaml").alias("path"), F.concat(F.lit("packages:\n  - 'packages/*'\n  - \"examples/*\" # all\n"), "l", F.lit("catalog:\n  x: 1\n")).alias("text"))
    return discover(rows.unionByName(spaces))


@query("s7_portable_read", f"WITH {A.ENTITIES} SELECT kind, count(*)::BIGINT AS n FROM entities WHERE rank <= 2 GROUP BY 1")
def _(t):
    e = A.entities(t)
    body = F.to_json(F.struct(F.lit("snap").alias("id"), F.collect_list(F.struct("id", "kind", "rank", "parent_id", "name")).alias("entities")))
    # All entities are written and read, some thousand to a file; the ranks asked for are told apart afterwards.
    parts = 1 + e.count() // 2000
    atlas = e.groupBy(F.pmod(F.xxhash64("id"), F.lit(parts)).alias("k")).agg(body.alias("text"))
    got, _ = bundles.read_portable(atlas.select(F.concat(F.lit("a"), F.col("k").cast("string"), F.lit(".json")).alias("path"), "text"))
    return got.where("rank <= 2").groupBy("kind").agg(F.count("*").alias("n"))


@query("s8_bundle_round_trip", f"WITH {A.ENTITIES} SELECT id, kind, parent_id FROM entities")
def _(t):
    at = scratch(t)
    bundles.write_bundle(A.entities(t), A.relations(t), "snap", at)
    return bundles.read_bundle(t.spark, at)[0].select("id", "kind", "parent_id")


#: Files of one brand hold the parts of a range of keys each, so their number grows with the table and their size doesn't.
_PKG = "SELECT p.p_brand || '-' || (min(p_partkey) // 10000) AS p_brand, p_name, min(p_size) AS v FROM part p GROUP BY p.p_brand, p_name"


def _packages(t: Tables):
    per = t.part.groupBy("p_brand", "p_name").agg(F.min("p_size").alias("v"), F.floor(F.min("p_partkey") / 10_000).alias("k"))
    return per.select(F.concat("p_brand", F.lit("-"), F.col("k").cast("string")).alias("p_brand"), "p_name", "v")


def _brand_files(t: Tables, body):
    """(path, text): files by brand and range, their lines or entries in name order."""
    rows = _packages(t).groupBy("p_brand").agg(F.sort_array(F.collect_list(F.struct("p_name", "v"))).alias("p"))
    return rows.select(F.col("p_brand").alias("path"), body(F.col("p")).alias("text"))


_version = lambda x: F.concat(x["v"].cast("string"), F.lit(".0.1"))


@query("s9_package_json", f"SELECT p_brand AS path, CASE WHEN v % 2 = 0 THEN 'dependencies' ELSE 'devDependencies' END AS section, p_name AS name, '^' || v || '.0.1' AS spec FROM ({_PKG})")
def _(t):
    pick = lambda p, odd: F.map_from_entries(F.transform(F.filter(p, lambda x: x["v"] % 2 == odd), lambda x: F.struct(x["p_name"], F.concat(F.lit("^"), _version(x)))))
    return files.package_json(_brand_files(t, lambda p: F.to_json(F.struct(pick(p, 0).alias("dependencies"), pick(p, 1).alias("devDependencies")))))


def _lines(p, head: str, line):
    return F.concat(F.lit(head), F.array_join(F.transform(p, line), "\n"), F.lit("\n"))


@query("s10_pnpm_lock", f"SELECT p_brand AS path, '.' AS importer, 'dependencies' AS section, p_name AS name, v || '.0.1' AS version FROM ({_PKG})")
def _(t):
    made = _brand_files(t, lambda p: _lines(p, "lockfileVersion: '9.0'\nimporters:\n  .:\n    dependencies:\n", lambda x: F.concat(F.lit("      '"), x["p_name"], F.lit("':\n        specifier: ^1\n        version: "), _version(x))))
    return files.parsed(made, "pnpm")


@query("s11_package_lock", f"SELECT p_brand AS path, p_name AS name, v || '.0.1' AS version FROM ({_PKG})")
def _(t):
    body = lambda p: F.to_json(F.struct(F.map_from_entries(F.transform(p, lambda x: F.struct(F.concat(F.lit("node_modules/"), x["p_name"]), F.struct(_version(x).alias("version"))))).alias("packages")))
    return files.package_lock(_brand_files(t, body))


@query("s12_yarn_lock", f"SELECT p_brand AS path, p_name AS name, '^1' AS spec, v || '.0.1' AS version FROM ({_PKG})")
def _(t):
    made = _brand_files(t, lambda p: _lines(p, "# yarn lockfile v1\n\n", lambda x: F.concat(F.lit('"'), x["p_name"], F.lit('@^1":\n  version "'), _version(x), F.lit('"\n'))))
    return files.parsed(made, "yarn")


_CRATE = "replace(replace(p_name, ' ', '_'), '#', '_')"
_crate = lambda x: F.translate(x["p_name"], " #", "__")


@query("s13_cargo_toml", f"SELECT DISTINCT p_brand AS path, 'dependencies' AS section, {_CRATE} AS name, {_CRATE} AS package, v || '.0' AS requirement, v % 2 = 0 AS optional FROM ({_PKG})")
def _(t):
    row = lambda x: F.concat(_crate(x), F.lit(' = { version = "'), x["v"].cast("string"), F.lit('.0", optional = '), F.when(x["v"] % 2 == 0, "true").otherwise("false"), F.lit(" }"))
    return files.parsed(_brand_files(t, lambda p: _lines(p, '[package]\nname = "x"\n[dependencies]\n', row)), "cargo_toml")


@query("s14_cargo_lock", f"SELECT p_brand AS path, {_CRATE} AS name, v || '.0.1' AS version, NULL::VARCHAR AS source FROM ({_PKG})")
def _(t):
    made = _brand_files(t, lambda p: _lines(p, "version = 3\n", lambda x: F.concat(F.lit('[[package]]\nname = "'), _crate(x), F.lit('"\nversion = "'), _version(x), F.lit('"'))))
    return files.parsed(made, "cargo_lock")


@query("s15_cargo_paths", f"SELECT p_brand AS path, (1 + row_number() OVER (PARTITION BY p_brand ORDER BY p_name))::INTEGER AS line, {_CRATE} AS name, '../' || {_CRATE} AS target FROM ({_PKG})")
def _(t):
    made = _brand_files(t, lambda p: _lines(p, "[dependencies]\n", lambda x: F.concat(_crate(x), F.lit(' = { path = "../'), _crate(x), F.lit('" }'))))
    return files.cargo_path_dependencies(made)


@query("s16_owner_rules", "SELECT * FROM (VALUES (2, '*', '@core'), (3, 'docs/', '@docs @web'), (5, '*.rs', '')) v(rule_no, pattern, owners)")
def _(t):
    rows = [("docs/CODEOWNERS", "* @late"), ("CODEOWNERS", "# owners\n* @core\ndocs/ @docs @web # note\n\n*.rs\n")]
    return files.owner_rules(t.spark.createDataFrame(rows, "path string, text string")).withColumn("owners", F.array_join("owners", " "))


_COV = "SELECT l_orderkey, l_linenumber AS line, count(*) FILTER (WHERE l_discount > 0.03) AS hits FROM lineitem GROUP BY 1, 2"


@query("s17_coverage_file", f"SELECT 'src/' || l_orderkey || '.ts' AS path, greatest(count(*), 3)::BIGINT AS found, count(*) FILTER (WHERE hits > 0)::BIGINT AS hit FROM ({_COV}) GROUP BY l_orderkey")
def _(t):
    lines = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.count_if(F.col("l_discount") > 0.03).alias("hits"))
    row = F.concat(F.lit("DA:"), F.col("l_linenumber").cast("string"), F.lit(","), F.col("hits").cast("string"))
    per = lines.groupBy("l_orderkey").agg(F.array_join(F.sort_array(F.collect_list(row)), "\n").alias("b"))
    text = F.concat(F.lit("TN:\nSF:src/"), F.col("l_orderkey").cast("string"), F.lit(".ts\n"), "b", F.lit("\nLF:3\nLH:0\nend_of_record\n"))
    # Tasks are given as a number: lines of a file weigh many times its compressed bytes.
    n = tasks_for(t.lineitem.select("l_orderkey", "l_linenumber", "l_discount"))
    each = per.select(F.floor(F.col("l_orderkey") / 2000).cast("string").alias("path"), text.alias("text")).repartition(n, "path")
    made = each.groupBy("path").agg(F.array_join(F.sort_array(F.collect_list("text")), "").alias("text"))
    hits, stored = files.coverage_records(made)
    return S.coverage(S.line_hits(hits), stored).drop("rate")


_PART = "'parts/' || p_partkey || '.ts' AS path"


@query("s18_imports", f"SELECT {_PART}, v.s AS specifier, v.dynamic FROM part, LATERAL (VALUES ('./brand/' || p_brand, FALSE), (lower(p_type), FALSE), ('./lazy/' || p_brand, TRUE)) v(s, dynamic)")
def _(t):
    return C.imports(code_tokens(A.script_files(t))).select("path", "specifier", "dynamic")


@query(
    "s19_declarations",
    f"SELECT {_PART}, v.name || p_partkey AS name, v.kind, v.line + CASE WHEN v.line > 4 THEN p_size % 5 ELSE 0 END AS line, v.exported FROM part,"
    " (VALUES ('part_', 'function', 4, TRUE), ('price_', 'const', 9, FALSE), ('over_', 'const', 10, FALSE), ('Box_', 'class', 11, FALSE)) v(name, kind, line, exported)",
)
def _(t):
    return C.declarations(code_tokens(A.script_files(t))).select("path", "name", "kind", "line", "exported")


@query(
    "s20_rust_outline",
    "SELECT 'suppliers/' || s_suppkey || '.rs' AS path, v.name, v.line, v.exported FROM supplier, LATERAL (VALUES ('Supplier' || s_suppkey, 4, TRUE), ('Supplier' || s_suppkey || '::fmt', 6, FALSE), ('balance_' || s_suppkey, 8, FALSE)) v(name, line, exported)",
)
def _(t):
    return C.rust_outline(code_tokens(A.rust_files(t), rust=True)).select("path", "name", "line", "exported")


@query("s21_rust_roots", "SELECT 'suppliers/' || s_suppkey || '.rs' AS path, v.root FROM supplier, LATERAL (VALUES ('std'), ('crate_' || s_nationkey)) v(root)")
def _(t):
    return C.rust_roots(code_tokens(A.rust_files(t), rust=True)).select("path", "root")


@query("s24_mermaid_import", "SELECT 'n' || a.n_regionkey AS from_id, 'k' || a.n_nationkey AS to_id, a.n_name AS label FROM nation a")
def _(t):
    line = F.concat(A.tag("  n", "n_regionkey"), F.lit(" -->|"), "n_name", F.lit("| "), A.tag("k", "n_nationkey"))
    made = t.nation.groupBy(F.col("n_regionkey").cast("string").alias("path")).agg(F.concat(F.lit("flowchart TD\n"), F.array_join(F.collect_list(line), "\n")).alias("text"))
    return files.mermaid(made).where("fact = 'edge'").select("from_id", "to_id", "label")


@query("s25_sequence_export", "SELECT conv_id, 'sequenceDiagram' || chr(10) || string_agg('  ' || role || '->>' || 'bot: ' || 'turn ' || turn, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY 1")
def _(t):
    steps = t.conversations.select("conv_id", "turn", "role", F.lit("bot").alias("to"), A.tag("turn ", "turn").alias("label"))
    return bundles.sequence_diagram(steps, "conv_id", "turn", "role", "to", "label")


@query("s26_capped_read", "SELECT doc_id FROM documents WHERE strlen(text) <= 2000")
def _(t):
    return t.documents.where(F.octet_length("text") <= 2000).select("doc_id")


@query("s27_packed_sink", "SELECT o_custkey, count(*)::BIGINT AS n FROM orders GROUP BY 1")
def _(t):
    at = scratch(t)
    t.orders.select("o_custkey", "o_orderkey").repartition(8, "o_custkey").sortWithinPartitions("o_custkey").write.parquet(at)
    return t.spark.read.parquet(at).groupBy("o_custkey").agg(F.count("*").alias("n"))


@query("s28_versioned_publish", "SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey % 2 = 0")
def _(t):
    at = scratch(t)
    bundles.publish(t.supplier.select("s_suppkey", "s_name"), at, "demo", "v1")
    bundles.publish(t.supplier.where("s_suppkey % 2 = 0").select("s_suppkey", "s_name"), at, "demo", "v2")
    return bundles.read_latest(t.spark, at, "demo")


@query("s29_manifest", "SELECT o_orderpriority AS slug, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS version FROM orders GROUP BY 1")
def _(t):
    return bundles.manifest(t.orders.select(F.col("o_orderpriority").alias("slug"), F.col("o_orderkey").alias("version"), F.col("o_orderdate").alias("at"))).select("slug", "version")


@query("s30_accounts_export", "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'")
def _(t):
    at = scratch(t)
    t.customer.where("c_mktsegment = 'BUILDING'").select("c_custkey", "c_name").orderBy("c_custkey").write.csv(at, header=True)
    return t.spark.read.schema("c_custkey long, c_name string").csv(at, header=True)


@query("s31_stress_graph", "SELECT 5000::BIGINT AS nodes, 15000::BIGINT AS edges, 0::BIGINT AS dangling")
def _(t):
    n, e = bundles.stress_graph(t.spark, 5000, 15_000)
    lost = V.foreign(e, "edges", "id", "to_id", n, "id").agg(F.count("*").alias("dangling"))
    return n.agg(F.count("*").alias("nodes")).crossJoin(e.agg(F.count("*").alias("edges"))).crossJoin(lost)


@query("v5_packet_rules", f"WITH {A.ENTITIES} SELECT 'entities/' || id AS path, 'unknown parent_id' AS message FROM entities WHERE parent_id IS NOT NULL AND parent_id NOT IN (SELECT id FROM entities WHERE id <> 'r2')")
def _(t):
    e = A.entities(t)
    return V.foreign(e, "entities", "id", "parent_id", e.where("id <> 'r2'"), "id")


@query("v7_authoring_rules", "SELECT 'authored/' || k AS path, 'duplicate id' AS message FROM (SELECT s_suppkey // 2 AS k FROM supplier) GROUP BY k HAVING count(*) > 1")
def _(t):
    return V.unique(t.supplier.select(F.floor(F.col("s_suppkey") / 2).alias("k")), "authored", "k")


_TURNS = "t AS (SELECT conv_id, turn, role, regexp_replace(trim(text), '\\s+', ' ', 'g') AS text, text AS raw FROM conversations), f AS (SELECT conv_id, min(turn) AS first FROM t GROUP BY 1)"


@query(
    "v12_explanation_rules",
    f"""WITH {_TURNS}, s AS (SELECT conv_id, min(raw) FILTER (WHERE turn = first) AS summary, count(*) FILTER (WHERE turn > first AND text <> '') AS points, coalesce(max(length(text)) FILTER (WHERE turn > first), 0) AS longest FROM t JOIN f USING (conv_id) GROUP BY 1)
SELECT conv_id AS id, CASE WHEN length(trim(summary)) > 600 THEN 'long summary' WHEN longest > 220 THEN 'long key point' ELSE 'key points' END AS fault FROM s WHERE length(trim(summary)) > 600 OR longest > 220 OR points NOT BETWEEN 2 AND 5""",
)
def _(t):
    turns = t.conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("s"))
    first = F.get("s", F.lit(0))["turn"]
    said = lambda keep: F.transform(F.filter("s", keep), lambda x: x["text"])
    return V.explanations(turns.select(F.col("conv_id").alias("id"), F.array_min(said(lambda x: x["turn"] == first)).alias("summary"), said(lambda x: x["turn"] > first).alias("key_points")))


@query("v13_table_shape", f"WITH {_TURNS}, s AS (SELECT conv_id, count(*) AS n, max(length(text)) AS longest FROM t GROUP BY 1) SELECT conv_id AS id, CASE WHEN n > 8 THEN 'rows' ELSE 'cells' END AS fault FROM s WHERE n > 8 OR longest > 160")
def _(t):
    rows = t.conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("s"))
    return V.tables(rows.select(F.col("conv_id").alias("id"), F.lit("Turns").alias("caption"), F.array(F.lit("role"), F.lit("text")).alias("columns"), F.transform("s", lambda x: F.array(x["role"], x["text"])).alias("rows")))


@query(
    "v13_flowchart_rules",
    "WITH c AS (SELECT o_custkey AS id, count(*) AS n, 12 + sum(1 + 7 + length(o_custkey::VARCHAR) + length(o_orderkey::VARCHAR)) AS chars FROM orders GROUP BY 1)"
    " SELECT id, CASE WHEN chars > 2000 THEN 'characters' WHEN n + 1 > 40 THEN 'lines' ELSE 'nodes' END AS fault FROM c WHERE chars > 2000 OR n + 1 > 40 OR n + 1 > 12",
)
def _(t):
    arrow = F.concat(F.lit("c"), F.col("o_custkey").cast("string"), F.lit(" --> o"), F.col("o_orderkey").cast("string"))
    made = t.orders.groupBy(F.col("o_custkey").alias("id")).agg(F.concat(F.lit("flowchart LR\n"), F.array_join(F.sort_array(F.collect_list(arrow)), "\n")).alias("source"))
    return V.flowcharts(made)

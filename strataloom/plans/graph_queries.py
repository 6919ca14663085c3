"""Graph queries (G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters as A
from ..operators import graph as G
from .registry import Tables, query

_G = A.GRAPH
_FOCUS = "r1"


@query("g1_descendants", f"WITH {A.ENTITIES}, {A.CLOSURE} SELECT ancestor_id, count(*)::BIGINT AS descendants FROM closure WHERE depth > 0 GROUP BY 1")
def _(t):
    return G.closure(A.entities(t)).where("depth > 0").groupBy("ancestor_id").agg(F.count("*").alias("descendants"))


@query("g2_ancestors", f"WITH {A.ENTITIES}, {A.CLOSURE} SELECT id, string_agg(ancestor_id, '/' ORDER BY depth DESC) AS chain FROM closure GROUP BY id")
def _(t):
    up = G.closure(A.entities(t)).groupBy("id").agg(F.sort_array(F.collect_list(F.struct((-F.col("depth")).alias("d"), "ancestor_id"))).alias("s"))
    return up.select("id", F.array_join(F.transform("s", lambda x: x["ancestor_id"]), "/").alias("chain"))


@query("g3_descendant_or_self", f"WITH {A.ENTITIES}, {A.CLOSURE} SELECT id FROM closure WHERE ancestor_id = '{_FOCUS}'")
def _(t):
    return G.closure(A.entities(t)).where(F.col("ancestor_id") == _FOCUS).select("id")


_REP = """SELECT c.id, coalesce(arg_min(c.ancestor_id, c.depth) FILTER (WHERE a.rank <= {r}), arg_max(c.ancestor_id, c.depth)) AS rep FROM closure c JOIN entities a ON a.id = c.ancestor_id GROUP BY c.id"""


@query("g4_representatives", f"WITH {A.ENTITIES}, {A.CLOSURE} {_REP.format(r=2)}")
def _(t):
    return G.representatives(A.entities(t), 2).select("id", "rep")


_LIFT = """lifted AS (SELECT r.*, f.rep AS rep_from, o.rep AS rep_to FROM relations r JOIN rep f ON r.from_id = f.id JOIN rep o ON r.to_id = o.id JOIN entities ef ON ef.id = r.from_id JOIN entities eo ON eo.id = r.to_id
 WHERE f.rep <> o.rep AND greatest(ef.rank, eo.rank) >= {r})"""


def _lift_sql(rank: int) -> str:
    return f"{_G}, rep AS ({_REP.format(r=rank)}), {_LIFT.format(r=rank)} "


def _edges_sql(rank: int) -> str:
    return (
        _lift_sql(rank)
        + """SELECT rep_from, rep_to, kind, count(*)::BIGINT AS count, coalesce(string_agg(DISTINCT label, '|' ORDER BY label), '') AS labels, string_agg(DISTINCT technology, '|' ORDER BY technology) AS technologies,
 count(*) FILTER (WHERE optional)::BIGINT AS optional_count, CASE WHEN count(DISTINCT label) = 1 AND count(label) = count(*) THEN min(label) WHEN count(*) = 1 THEN coalesce(min(label), kind)
 ELSE count(*) || ' ' || kind END AS label FROM lifted GROUP BY rep_from, rep_to, kind"""
    )


def _edges(t: Tables, rank: int):
    e = G.visual_edges(A.relations(t), A.entities(t), rank).drop("first_id")
    return e.withColumns({"labels": F.array_join("labels", "|"), "technologies": F.array_join("technologies", "|")})


@query("g5_lift_container", _edges_sql(1))
def _(t):
    return _edges(t, 1)


@query("a1_visual_edges_component", _edges_sql(2))
def _(t):
    return _edges(t, 2)


@query(
    "g6_band_projection",
    " UNION ALL ".join(f"(SELECT {r} AS band, n.nodes, e.edges FROM (WITH {A.ENTITIES} SELECT count(*)::BIGINT AS nodes FROM entities WHERE rank <= {r}) n, ({_lift_sql(r)} SELECT count(*)::BIGINT AS edges FROM (SELECT DISTINCT rep_from, rep_to, kind FROM lifted)) e)" for r in range(4)),
)
def _(t):
    e, r = A.entities(t), A.relations(t)
    nodes = e.agg(*(F.count_if(F.col("rank") <= k).alias(f"n{k}") for k in range(4)))
    pairs = G.lifted_bands(r, e, list(range(4))).select("band", "rep_from", "rep_to", "kind").distinct()
    edges = pairs.agg(*(F.count_if(F.col("band") == k).alias(f"e{k}") for k in range(4)))
    # One row each.
    rows = F.array(*(F.struct(F.lit(k).alias("band"), F.col(f"n{k}").alias("nodes"), F.col(f"e{k}").alias("edges")) for k in range(4)))
    return nodes.crossJoin(edges).select(F.explode(rows).alias("x")).select("x.*")


_SLICE = f"SELECT id, CASE min(o) WHEN 0 THEN 'subtree' WHEN 1 THEN 'ancestor' ELSE 'root' END AS role FROM (SELECT c.id, 0 AS o FROM closure c JOIN entities e ON e.id = c.id WHERE c.ancestor_id = '{_FOCUS}' AND e.rank <= 2 UNION ALL SELECT ancestor_id, 1 FROM closure WHERE id = '{_FOCUS}' AND depth > 0 UNION ALL SELECT id, 2 FROM entities WHERE parent_id IS NULL) GROUP BY id"


@query("g7_neighborhood", f"WITH {A.ENTITIES}, {A.CLOSURE} {_SLICE}")
def _(t):
    return G.neighborhood(A.entities(t), A.relations(t), _FOCUS, 2)


@query("g8_focus_owner", f"WITH {A.ENTITIES}, {A.CLOSURE} SELECT c.id, arg_min(c.ancestor_id, c.depth) AS owner FROM closure c JOIN entities a ON a.id = c.ancestor_id WHERE a.kind = 'container' GROUP BY c.id")
def _(t):
    e = A.entities(t)
    owners = e.where("kind = 'container'").select(F.col("id").alias("ancestor_id"))
    return G.closure(e).join(owners, "ancestor_id", "left_semi").groupBy("id").agg(F.min_by("ancestor_id", "depth").alias("owner"))


@query("g9_small_graph_gate", f"WITH {A.ENTITIES} SELECT count(*) FILTER (WHERE kind = 'container') <= 12 AND count(*) FILTER (WHERE kind = 'component') <= 2000 AS small FROM entities")
def _(t):
    return A.entities(t).agg(((F.count_if(F.col("kind") == "container") <= 12) & (F.count_if(F.col("kind") == "component") <= 2000)).alias("small"))


#: Parts have no arcs, so three hops reach all; the least path to a node goes on from the least one to the node before.
_BFS = f"""WITH {A.FLOWS}, w0 AS (SELECT DISTINCT from_id AS source, from_id AS node, [from_id] AS path FROM flows WHERE from_id LIKE 'n%'),
 w1 AS (SELECT source, to_id AS node, min(list_append(path, to_id)) AS path FROM w0 JOIN flows ON node = from_id GROUP BY 1, 2),
 w2 AS (SELECT source, to_id AS node, min(list_append(path, to_id)) AS path FROM w1 JOIN flows ON node = from_id GROUP BY 1, 2),
 w3 AS (SELECT source, to_id AS node, min(list_append(path, to_id)) AS path FROM w2 JOIN flows ON node = from_id GROUP BY 1, 2)
 SELECT source, node, (len(path) - 1)::INTEGER AS hops, array_to_string(path, '>') AS path FROM (SELECT * FROM w0 UNION ALL SELECT * FROM w1 UNION ALL SELECT * FROM w2 UNION ALL SELECT * FROM w3)"""


@query("g10_canonical_paths", _BFS)
def _(t):
    starts = t.customer.select(A.tag("n", "c_nationkey").alias("source")).distinct()
    return G.shortest_paths(A.repeated_flows(t), starts).withColumn("path", F.array_join("path", ">"))


@query("g11_hop_evidence", f"WITH {A.ENTITIES}, {A.RELATIONS} SELECT from_id, to_id, min(id) AS relation_id, sum(evidence)::BIGINT AS evidence, count(*)::BIGINT AS parallel FROM relations GROUP BY 1, 2")
def _(t):
    return A.relations(t).groupBy("from_id", "to_id").agg(F.min("id").alias("relation_id"), F.sum("evidence").alias("evidence"), F.count("*").alias("parallel"))


_SCOPE = f"""sub AS (SELECT id FROM closure WHERE ancestor_id = 'n3'), hop AS (SELECT to_id AS id FROM relations WHERE from_id IN (SELECT id FROM sub) UNION SELECT from_id FROM relations WHERE to_id IN (SELECT id FROM sub))
 SELECT id FROM sub UNION SELECT ancestor_id FROM closure WHERE id = 'n3' UNION SELECT id FROM hop"""


@query("g12_scoped_view", f"{_G}, {_SCOPE}")
def _(t):
    e, r = A.entities(t), A.relations(t)
    up = G.closure(e)
    sub = up.where("ancestor_id = 'n3'").select("id")
    hop = G.incident(r, sub.withColumnRenamed("id", "node")).select(F.col("other").alias("id"))
    return sub.union(up.where("id = 'n3'").select("ancestor_id")).union(hop).distinct()


@query("g13_isolate", f"WITH {A.ENTITIES} SELECT s.id FROM entities s JOIN entities f ON f.id = 'n3' AND s.parent_id = f.parent_id AND s.kind = f.kind ORDER BY s.id LIMIT 50")
def _(t):
    e = A.entities(t)
    f = e.where("id = 'n3'").select(F.col("parent_id").alias("p"), F.col("kind").alias("k"))
    return e.join(f, (F.col("parent_id") == F.col("p")) & (F.col("kind") == F.col("k"))).orderBy("id").limit(50).select("id")


@query("g14_consumers", f"WITH {A.ENTITIES}, {A.RELATIONS} SELECT DISTINCT from_id AS id FROM relations WHERE to_id IN ('s1', 's2', 's3') AND kind NOT IN ('contains', 'duplicates') AND from_id <> to_id")
def _(t):
    return A.relations(t).where(F.col("to_id").isin("s1", "s2", "s3") & ~F.col("kind").isin("contains", "duplicates") & (F.col("from_id") != F.col("to_id"))).select(F.col("from_id").alias("id")).distinct()


_IMPACT = f"""seed AS (SELECT 'c' || c_custkey AS id FROM customer WHERE c_acctbal < -900), dirty AS (SELECT DISTINCT ancestor_id AS id FROM closure WHERE id IN (SELECT id FROM seed)),
 used AS (SELECT DISTINCT to_id AS id FROM relations WHERE from_id IN (SELECT id FROM seed)), stale AS (SELECT id FROM used WHERE id NOT IN (SELECT id FROM dirty))
 SELECT id, CASE WHEN id IN (SELECT id FROM dirty) THEN 'dirty' WHEN id IN (SELECT id FROM stale) THEN 'stale' ELSE 'reused' END AS state FROM entities"""


@query("g15_impact", f"{_G}, {_IMPACT}")
def _(t):
    e = A.entities(t)
    seed = t.customer.where("c_acctbal < -900").select(A.tag("c", "c_custkey").alias("id"))
    dirty = G.closure(e).join(seed, "id", "left_semi").select(F.col("ancestor_id").alias("d")).distinct()
    stale = A.relations(t).join(seed.withColumnRenamed("id", "from_id"), "from_id", "left_semi").select(F.col("to_id").alias("s")).distinct()
    both = e.join(dirty, F.col("id") == F.col("d"), "left").join(stale, F.col("id") == F.col("s"), "left")
    return both.select("id", F.when(F.col("d").isNotNull(), "dirty").when(F.col("s").isNotNull(), "stale").otherwise("reused").alias("state"))


@query("g16_degrees", f"WITH {A.ENTITIES}, {A.RELATIONS} SELECT e.id, coalesce(d.n, 0)::BIGINT AS degree, coalesce(k.n, 0)::BIGINT AS children FROM entities e LEFT JOIN (SELECT id, count(*) AS n FROM (SELECT from_id AS id FROM relations UNION ALL SELECT to_id FROM relations) GROUP BY id) d USING (id) LEFT JOIN (SELECT parent_id AS id, count(*) AS n FROM entities GROUP BY 1) k USING (id)")
def _(t):
    e = A.entities(t)
    kids = e.where("parent_id IS NOT NULL").groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("children"))
    return e.select("id").join(G.degrees(A.relations(t)), "id", "left").join(kids, "id", "left").na.fill(0, ["degree", "children"])


@query("g17_weighted_rank", f"WITH {A.ENTITIES}, {A.RELATIONS}, d AS (SELECT id, count(*) AS n FROM (SELECT from_id AS id FROM relations UNION ALL SELECT to_id FROM relations) GROUP BY id), k AS (SELECT parent_id AS id, count(*) AS n FROM entities GROUP BY 1) SELECT id, (coalesce(k.n, 0) * 1000 + coalesce(d.n, 0))::BIGINT AS score FROM entities LEFT JOIN d USING (id) LEFT JOIN k USING (id) ORDER BY score DESC, id LIMIT 30")
def _(t):
    e = A.entities(t)
    kids = e.where("parent_id IS NOT NULL").groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("k"))
    both = e.select("id").join(G.degrees(A.relations(t)), "id", "left").join(kids, "id", "left").na.fill(0)
    return both.select("id", (F.col("k") * 1000 + F.col("degree")).alias("score")).orderBy(F.desc("score"), "id").limit(30)


@query("g18_claim_overlap", "SELECT p_type AS path, count(DISTINCT p_brand)::BIGINT AS containers FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) > 1")
def _(t):
    return t.part.groupBy(F.col("p_type").alias("path")).agg(F.count_distinct("p_brand").alias("containers")).where("containers > 1")


@query("g19_regroup", f"WITH {A.ENTITIES}, {A.RELATIONS}, m AS (SELECT 's' || s_suppkey AS old, 'g' || (s_suppkey % 7) AS new FROM supplier) SELECT from_id, coalesce(m.new, to_id) AS to_id, kind, count(*)::BIGINT AS count FROM relations LEFT JOIN m ON to_id = m.old GROUP BY ALL")
def _(t):
    moves = t.supplier.select(A.tag("s", "s_suppkey").alias("old"), F.concat(F.lit("g"), (F.col("s_suppkey") % 7).cast("string")).alias("new"))
    return G.regroup(A.entities(t), A.relations(t), moves).drop("first_id")


@query("g20_forest_counts", f"WITH {A.ENTITIES}, {A.CLOSURE} SELECT e.id, array_to_string(list(c.ancestor_id ORDER BY c.depth DESC), '/') AS path, (count(*) - 1)::INTEGER AS level, (SELECT count(*) - 1 FROM closure x WHERE x.ancestor_id = e.id)::BIGINT AS descendants FROM entities e JOIN closure c ON c.id = e.id GROUP BY e.id")
def _(t):
    e = A.entities(t)
    f = G.forest(e).select("id", F.array_join("path", "/").alias("path"), "level")
    return f.join(G.subtree_counts(e).select("id", "descendants"), "id")


@query("g21_kind_lookup", f"WITH {A.ENTITIES}, {A.CLOSURE} SELECT c.id, min(c.ancestor_id) AS component FROM closure c JOIN entities a ON a.id = c.ancestor_id AND a.kind = 'component' JOIN entities e ON e.id = c.id AND e.name LIKE '%00001%' GROUP BY c.id")
def _(t):
    e = A.entities(t)
    comps = e.where("kind = 'component'").select(F.col("id").alias("ancestor_id"))
    named = e.where(F.contains("name", F.lit("00001"))).select("id")
    return G.closure(e).join(comps, "ancestor_id", "left_semi").join(named, "id", "left_semi").groupBy("id").agg(F.min("ancestor_id").alias("component"))


@query("g22_inner_relations", f"{_G}, rep AS ({_REP.format(r=1)}) SELECT f.rep AS id, count(*)::BIGINT AS inner_relations FROM relations r JOIN rep f ON f.id = r.from_id JOIN rep o ON o.id = r.to_id WHERE f.rep = o.rep GROUP BY 1")
def _(t):
    rep = G.representatives(A.entities(t), 1)
    f = rep.select(F.col("id").alias("from_id"), F.col("rep").alias("a"))
    o = rep.select(F.col("id").alias("to_id"), F.col("rep").alias("b"))
    return A.relations(t).join(f, "from_id").join(o, "to_id").where("a = b").groupBy(F.col("a").alias("id")).agg(F.count("*").alias("inner_relations"))


@query("g23_extract_graph", f"WITH {A.ENTITIES}, {A.RELATIONS} SELECT 'entity' AS fact, kind, count(*)::BIGINT AS n FROM entities GROUP BY ALL UNION ALL SELECT 'relation', kind, count(*)::BIGINT FROM relations GROUP BY ALL")
def _(t):
    e = A.entities(t).groupBy(F.lit("entity").alias("fact"), "kind").agg(F.count("*").alias("n"))
    return e.unionAll(A.relations(t).groupBy(F.lit("relation").alias("fact"), "kind").agg(F.count("*").alias("n")))


_ALIAS = "l AS (SELECT s_suppkey AS name, s_suppkey // 4 AS target FROM supplier WHERE s_suppkey >= 4)"


@query("g24_exposure", f"WITH RECURSIVE {_ALIAS}, w(name, target) AS (SELECT * FROM l UNION SELECT w.name, l.target FROM w JOIN l ON w.target = l.name) SELECT target AS exposed, count(DISTINCT name)::BIGINT AS through FROM w WHERE target NOT IN (SELECT name FROM l) GROUP BY 1")
def _(t):
    links = t.supplier.where("s_suppkey >= 4").select(F.col("s_suppkey").alias("name"), F.floor(F.col("s_suppkey") / 4).alias("target"))
    return G.alias_fixpoint(links).groupBy(F.col("target").alias("exposed")).agg(F.count("*").alias("through"))


@query("g25_shim_folding", "WITH s AS (SELECT s_suppkey AS shim, s_suppkey - 1 AS real FROM supplier WHERE s_suppkey % 10 = 5) SELECT coalesce(s.real, l_suppkey) AS target, count(*)::BIGINT AS n FROM lineitem LEFT JOIN s ON l_suppkey = s.shim GROUP BY 1")
def _(t):
    shims = t.supplier.where("s_suppkey % 10 = 5").select(F.col("s_suppkey").alias("shim"), (F.col("s_suppkey") - 1).alias("real"))
    return t.lineitem.join(shims, F.col("l_suppkey") == F.col("shim"), "left").groupBy(F.coalesce("real", "l_suppkey").alias("target")).agg(F.count("*").alias("n"))


@query("g26_band_transitions", f"WITH {A.ENTITIES}, {A.CLOSURE}, a AS ({_REP.format(r=1)}), b AS ({_REP.format(r=2)}) SELECT a.rep AS from_node, b.rep AS to_node, count(*)::BIGINT AS members FROM a JOIN b ON a.id = b.id GROUP BY 1, 2")
def _(t):
    e = A.entities(t)
    a = G.representatives(e, 1).select("id", F.col("rep").alias("from_node"))
    b = G.representatives(e, 2).select("id", F.col("rep").alias("to_node"))
    return a.join(b, "id").groupBy("from_node", "to_node").agg(F.count("*").alias("members"))


@query("g27_contextual_overview", f"WITH {A.ENTITIES}, {A.RELATIONS}, x AS (SELECT 's5' AS f) SELECT id, relationship FROM (SELECT parent_id AS id, 'parent' AS relationship FROM entities, x WHERE entities.id = f UNION SELECT entities.id, 'child' FROM entities, x WHERE parent_id = f UNION SELECT to_id, 'dependency' FROM relations, x WHERE from_id = f AND to_id <> f UNION SELECT from_id, 'dependent' FROM relations, x WHERE to_id = f AND from_id <> f) WHERE id IS NOT NULL")
def _(t):
    e, f = A.entities(t), "s5"
    node = e.where(F.col("id") == f).select(F.col("id").alias("node"))
    links = G.incident(A.relations(t), node).where("other <> node").select(F.col("other").alias("id"), F.when(F.col("direction") == "out", "dependency").otherwise("dependent").alias("relationship"))
    kin = e.where(F.col("id") == f).select(F.col("parent_id").alias("id"), F.lit("parent").alias("relationship")).unionAll(e.where(F.col("parent_id") == f).select("id", F.lit("child")))
    return kin.unionAll(links).where("id IS NOT NULL").distinct()


@query("g28_related_nodes", f"WITH {A.ENTITIES}, {A.RELATIONS} SELECT o AS id, count(*)::BIGINT AS links FROM (SELECT to_id AS o FROM relations WHERE from_id = 's5' UNION ALL SELECT from_id FROM relations WHERE to_id = 's5') GROUP BY 1 ORDER BY links DESC, id LIMIT 12")
def _(t):
    node = t.spark.createDataFrame([("s5",)], "node string")
    return G.incident(A.relations(t), node).groupBy(F.col("other").alias("id")).agg(F.count("*").alias("links")).orderBy(F.desc("links"), "id").limit(12)


@query("g30_kind_ranked_nodes", f"WITH {A.ENTITIES} SELECT id, (count(*) OVER () - 40)::BIGINT AS omitted FROM entities ORDER BY rank, id LIMIT 40")
def _(t):
    e = A.entities(t)
    total = e.agg((F.count("*") - 40).alias("omitted"))
    return e.orderBy("rank", "id").limit(40).select("id").crossJoin(total)


@query("g31_container_scopes", f"WITH {A.ENTITIES}, {A.CLOSURE} SELECT c.ancestor_id AS id, count(*) FILTER (WHERE e.kind = 'component')::BIGINT AS components, count(*) FILTER (WHERE e.kind = 'code')::BIGINT AS code FROM closure c JOIN entities e ON e.id = c.id JOIN entities a ON a.id = c.ancestor_id AND a.kind = 'container' GROUP BY 1")
def _(t):
    e = A.entities(t)
    top = e.where("kind = 'container'").select(F.col("id").alias("ancestor_id"))
    below = G.closure(e).join(top, "ancestor_id", "left_semi").join(e.select("id", "kind"), "id")
    return below.groupBy(F.col("ancestor_id").alias("id")).agg(F.count_if(F.col("kind") == "component").alias("components"), F.count_if(F.col("kind") == "code").alias("code"))


_SEL = "sel AS (SELECT id FROM entities WHERE kind = 'code' AND id LIKE 's%1')"


@query("g32_unselected_ancestors", f"WITH {A.ENTITIES}, {A.CLOSURE}, {_SEL} SELECT DISTINCT ancestor_id AS id FROM closure WHERE id IN (SELECT id FROM sel) AND ancestor_id NOT IN (SELECT id FROM sel)")
def _(t):
    e = A.entities(t)
    sel = e.where("kind = 'code' AND id LIKE 's%1'").select("id")
    up = G.closure(e).join(sel, "id", "left_semi").select(F.col("ancestor_id").alias("id")).distinct()
    return up.join(sel, "id", "left_anti")


@query("g33_subtree_selection", f"WITH {A.ENTITIES}, {A.CLOSURE} SELECT c.id FROM closure c JOIN entities e ON e.id = c.id WHERE c.ancestor_id = '{_FOCUS}' AND e.kind <> 'code'")
def _(t):
    e = A.entities(t)
    return G.closure(e).where(F.col("ancestor_id") == _FOCUS).join(e.where("kind <> 'code'").select("id"), "id", "left_semi").select("id")


@query("g34_ask_scope", f"WITH {A.ENTITIES}, {A.CLOSURE} SELECT id, 'inside' AS scope FROM closure WHERE ancestor_id = 'n4' UNION ALL SELECT ancestor_id, 'above' FROM closure WHERE id = 'n4' AND depth > 0")
def _(t):
    up = G.closure(A.entities(t))
    return up.where("ancestor_id = 'n4'").select("id", F.lit("inside").alias("scope")).unionAll(up.where("id = 'n4' AND depth > 0").select("ancestor_id", F.lit("above")))


@query("g35_relation_framing", f"{_G}, rep AS ({_REP.format(r=1)}) SELECT CASE WHEN a.parent_id = b.parent_id THEN 'sameParent' WHEN f.rep = o.rep THEN 'sameContainer' ELSE 'crossContainer' END AS framing, count(*)::BIGINT AS n FROM relations r JOIN rep f ON f.id = r.from_id JOIN rep o ON o.id = r.to_id JOIN entities a ON a.id = r.from_id JOIN entities b ON b.id = r.to_id GROUP BY 1")
def _(t):
    e = A.entities(t)
    rep = G.representatives(e, 1).join(e.select("id", "parent_id"), "id")
    side = lambda end, s: rep.select(F.col("id").alias(f"{end}_id"), F.col("rep").alias(f"rep_{s}"), F.col("parent_id").alias(f"par_{s}"))
    both = A.relations(t).join(side("from", "a"), "from_id").join(side("to", "b"), "to_id")
    framing = F.when(F.col("par_a") == F.col("par_b"), "sameParent").when(F.col("rep_a") == F.col("rep_b"), "sameContainer").otherwise("crossContainer")
    return both.groupBy(framing.alias("framing")).agg(F.count("*").alias("n"))

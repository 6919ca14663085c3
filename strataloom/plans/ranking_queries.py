"""Ranks and windows (W), sorts and pages (K), sets (U)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import adapters as A
from ..operators import graph as G
from ..operators import ranking as R
from .registry import query


@query("w1_rank_in_parent", f"WITH {A.ENTITIES}, {A.CLOSURE}, w AS (SELECT ancestor_id AS id, count(*) AS n FROM closure GROUP BY 1), r AS (SELECT parent_id, id, n, row_number() OVER (PARTITION BY parent_id ORDER BY n DESC, id) AS rank, count(*) OVER (PARTITION BY parent_id) AS total FROM entities JOIN w USING (id) WHERE parent_id IS NOT NULL) SELECT parent_id, id, rank::INTEGER AS rank, greatest(total - 5, 0)::BIGINT AS more FROM r WHERE rank <= 5")
def _(t):
    e = A.entities(t)
    w = G.closure(e).groupBy(F.col("ancestor_id").alias("id")).agg(F.count("*").alias("n"))
    kids = e.where("parent_id IS NOT NULL").select("parent_id", "id").join(w, "id")
    more = kids.groupBy("parent_id").agg(F.greatest(F.count("*") - 5, F.lit(0)).alias("more"))
    return R.rank_within(kids, ["parent_id"], [F.desc("n"), F.col("id")], 5).join(more, "parent_id").select("parent_id", "id", "rank", "more")


@query("w2_soft_diversity", "SELECT doc_id, floor(n_chars * pow(0.95, n - 1) * 1000 + 0.137)::BIGINT AS milli_score FROM (SELECT doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS n FROM documents)")
def _(t):
    r = R.rank_within(t.documents.select("doc_id", "source", "n_chars"), ["source"], [F.desc("n_chars"), F.col("doc_id")])
    return r.select("doc_id", F.floor(F.col("n_chars") * F.pow(F.lit(0.95), F.col("rank") - 1) * 1000 + 0.137).cast("long").alias("milli_score"))


@query("w3_child_rollup", "WITH r AS (SELECT source, lang, n_chars AS s, row_number() OVER (PARTITION BY source, lang ORDER BY n_chars DESC, doc_id) AS n FROM documents), f AS (SELECT source, lang, sum(CASE WHEN n = 1 THEN s WHEN n <= 6 THEN 0.1 * s ELSE 0 END) AS s FROM r GROUP BY 1, 2) SELECT source, round(0.2 * max(s), 4)::DOUBLE AS score FROM f GROUP BY 1")
def _(t):
    r = R.rank_within(t.documents.select("source", "lang", "n_chars", "doc_id"), ["source", "lang"], [F.desc("n_chars"), F.col("doc_id")], 6)
    share = F.when(F.col("rank") == 1, F.col("n_chars")).otherwise(0.1 * F.col("n_chars"))
    files = r.groupBy("source", "lang").agg(F.sum(share).alias("s"))
    return files.groupBy("source").agg(F.round(0.2 * F.max("s"), 4).alias("score"))


@query("w4_degree_sample", "WITH d AS (SELECT l_suppkey AS id, count(*) AS n FROM lineitem GROUP BY 1), r AS (SELECT s_nationkey, id, row_number() OVER (PARTITION BY s_nationkey ORDER BY n DESC, id) AS k FROM d JOIN supplier ON s_suppkey = id) SELECT s_nationkey, id FROM r WHERE k <= 2")
def _(t):
    d = t.lineitem.groupBy(F.col("l_suppkey").alias("id")).agg(F.count("*").alias("n"))
    both = d.join(t.supplier, F.col("id") == F.col("s_suppkey"))
    return R.rank_within(both, ["s_nationkey"], [F.desc("n"), F.col("id")], 2).select("s_nationkey", "id")


@query("w5_collision_numbers", "WITH d AS (SELECT p_partkey, lower(p_type) AS want, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS n FROM part) SELECT p_partkey, CASE WHEN n = 1 THEN want ELSE want || '-' || n END AS unique_id FROM d")
def _(t):
    return R.number_collisions(t.part.select("p_partkey", F.lower("p_type").alias("want")), "want", ["p_partkey"]).select("p_partkey", "unique_id")


@query("w6_latest_row", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def _(t):
    last = t.events.groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type"), F.struct("ts", "event_id")).alias("x"))
    return last.select("user_id", "x.*")


@query("w7_matches_below", f"WITH {A.ENTITIES}, {A.CLOSURE} SELECT c.ancestor_id AS id, count(*) FILTER (WHERE c.depth > 0)::BIGINT AS below, count(*) FILTER (WHERE c.depth > 0 AND e.name LIKE '%7%')::BIGINT AS matches FROM closure c JOIN entities e ON e.id = c.id GROUP BY 1")
def _(t):
    e = A.entities(t)
    up = G.closure(e).join(e.select("id", "name"), "id")
    below = F.col("depth") > 0
    return up.groupBy(F.col("ancestor_id").alias("id")).agg(F.count_if(below).alias("below"), F.count_if(below & F.contains("name", F.lit("7"))).alias("matches"))


@query("w8_keyframes", "SELECT event_id, user_id, value + coalesce((lead(value) OVER w - value) * 0.5, 0) AS middle, date_diff('second', ts, lead(ts) OVER w)::BIGINT AS seconds FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def _(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    nxt = F.lead("value").over(w)
    gap = F.unix_timestamp(F.lead("ts").over(w)) - F.unix_timestamp("ts")
    return t.events.select("event_id", "user_id", (F.col("value") + F.coalesce((nxt - F.col("value")) * 0.5, F.lit(0))).alias("middle"), gap.alias("seconds"))


@query("w9_even_sample", "WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents) SELECT source, doc_id FROM r WHERE i IN (SELECT k * (n - 1) // 5 FROM range(6) t(k))")
def _(t):
    r = R.rank_within(t.documents.select("source", "doc_id"), ["source"], ["doc_id"]).withColumn("i", F.col("rank") - 1)
    n = t.documents.groupBy("source").agg(F.count("*").alias("n"))
    spots = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda k: F.floor(k * (F.col("n") - 1) / 5))
    return r.join(n, "source").where(F.array_contains(spots, F.col("i").cast("long"))).select("source", "doc_id")


@query("w10_first_occurrence", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def _(t):
    return t.events.groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))


@query("w11_chunks", "SELECT source, chunk::BIGINT AS chunk, count(*)::BIGINT AS n FROM (SELECT source, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 8 AS chunk FROM documents) GROUP BY 1, 2")
def _(t):
    r = R.rank_within(t.documents.select("source", "doc_id"), ["source"], ["doc_id"])
    return r.groupBy("source", F.floor((F.col("rank") - 1) / 8).alias("chunk")).agg(F.count("*").alias("n"))


@query("w12_story_chain", f"WITH {A.ENTITIES}, {A.CLOSURE}, w AS (SELECT ancestor_id AS id, count(*) AS n FROM closure GROUP BY 1), a AS (SELECT id FROM entities JOIN w USING (id) WHERE kind = 'container' ORDER BY n DESC, id LIMIT 1), b AS (SELECT id FROM entities JOIN w USING (id) WHERE parent_id = (SELECT id FROM a) ORDER BY n DESC, id LIMIT 1), c AS (SELECT id FROM entities WHERE parent_id = (SELECT id FROM b) ORDER BY id LIMIT 1) SELECT 1 AS step, id FROM a UNION ALL SELECT 2, id FROM b UNION ALL SELECT 3, id FROM c")
def _(t):
    e = A.entities(t)
    w = G.closure(e).groupBy(F.col("ancestor_id").alias("i")).agg(F.count("*").alias("n"))
    e = e.join(w, F.col("id") == F.col("i"))
    best = lambda df: df.orderBy(F.desc("n"), "id").limit(1).select("id")
    under = lambda top: e.join(top.withColumnRenamed("id", "p"), F.col("parent_id") == F.col("p"))
    a = best(e.where("kind = 'container'"))
    b = best(under(a))
    c = under(b).orderBy("id").limit(1).select("id")
    step = lambda df, n: df.select(F.lit(n).alias("step"), "id")
    return step(a, 1).unionAll(step(b, 2)).unionAll(step(c, 3))


@query("w13_tier_order", "SELECT c_nationkey, min(CASE WHEN c_acctbal < 0 THEN 0 WHEN c_acctbal < 1000 THEN 1 ELSE 2 END)::INTEGER AS tier, count(*)::BIGINT AS n FROM customer GROUP BY 1 ORDER BY tier, c_nationkey")
def _(t):
    tier = F.when(F.col("c_acctbal") < 0, 0).when(F.col("c_acctbal") < 1000, 1).otherwise(2)
    return t.customer.groupBy("c_nationkey").agg(F.min(tier).alias("tier"), F.count("*").alias("n")).orderBy("tier", "c_nationkey")


@query("w14_last_running", "SELECT user_id, max(ts) FILTER (WHERE event_type = 'click') AS at FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "click", F.col("ts"))).alias("at"))


@query("k1_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def _(t):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)


@query("k2_edge_budget", f"WITH {A.ENTITIES}, {A.RELATIONS} SELECT id, (SELECT count(*) - 64 FROM relations)::BIGINT AS omitted FROM relations ORDER BY (from_id = 'c1' OR to_id = 's1') DESC, evidence DESC, id LIMIT 64")
def _(t):
    r = A.relations(t)
    touches = (F.col("from_id") == "c1") | (F.col("to_id") == "s1")
    return R.top_with_rest(r.select("id", "evidence", touches.alias("touches")), [F.desc("touches"), F.desc("evidence"), "id"], 64).select("id", "omitted")


@query("k3_nearest", "WITH b AS (SELECT p_partkey AS id, p_retailprice AS x, p_size * 10 AS y FROM part) SELECT id FROM b WHERE id % 500 = 1 UNION ALL (SELECT id FROM b WHERE id % 500 <> 1 AND x < 1500 AND x + 20 > 1000 AND y < 400 AND y + 20 > 100 ORDER BY (x + 10.0 - 1250) * (x + 10.0 - 1250) + (y + 10.0 - 250) * (y + 10.0 - 250), id LIMIT 60 - (SELECT count(*) FROM b WHERE id % 500 = 1))")
def _(t):
    from ..operators.spatial import resident

    boxes = t.part.select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("x"), (F.col("p_size") * 10).alias("y"), F.lit(20).alias("w"), F.lit(20).alias("h"))
    return resident(boxes, (1000, 100, 500, 300), boxes.where("id % 500 = 1").select("id"), 60).select("id")


@query("k4_cursor_page", "SELECT doc_id FROM documents WHERE lang = 'en' ORDER BY n_chars DESC, doc_id LIMIT 25 OFFSET 50")
def _(t):
    en, order = t.documents.where("lang = 'en'").select("doc_id", "n_chars"), [F.desc("n_chars"), F.col("doc_id")]
    cursor = R.encode_cursor("search:en", 50)
    return R.page(en, order, "search:en", cursor, 25)[0].select("doc_id")


@query("k5_digest_page", "SELECT sha256(string_agg(n_nationkey || '=' || n_name, '|' ORDER BY n_nationkey)) AS digest, count(*)::BIGINT AS n FROM nation")
def _(t):
    row = F.concat(F.col("n_nationkey").cast("string"), F.lit("="), F.col("n_name"))
    listing = F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", row.alias("r")))), lambda x: x["r"])
    return t.nation.agg(F.sha2(F.array_join(listing, "|"), 256).alias("digest"), F.count("*").alias("n"))


@query("k6_directory_sort", "SELECT c_custkey, o_last FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS o_last FROM orders GROUP BY 1) ON o_custkey = c_custkey ORDER BY o_last DESC NULLS LAST, lower(c_name), c_custkey LIMIT 200")
def _(t):
    last = t.orders.groupBy("o_custkey").agg(F.max("o_orderdate").alias("o_last"))
    both = t.customer.join(last, F.col("c_custkey") == F.col("o_custkey"), "left")
    return both.orderBy(F.desc_nulls_last("o_last"), F.lower("c_name"), "c_custkey").limit(200).select("c_custkey", "o_last")


@query("k7_multi_key_sort", "SELECT p_partkey FROM part ORDER BY p_brand, p_size DESC NULLS LAST, lpad(regexp_extract(p_name, '[0-9]+'), 12, '0'), p_partkey LIMIT 120")
def _(t):
    return t.part.orderBy("p_brand", F.desc_nulls_last("p_size"), R.natural_key(F.regexp_extract("p_name", "[0-9]+", 0)), "p_partkey").limit(120).select("p_partkey")


@query("k8_retry_order", "SELECT event_id FROM events ORDER BY CASE event_type WHEN 'error' THEN 0 WHEN 'view' THEN 1 WHEN 'signup' THEN 2 ELSE 3 END, event_id LIMIT 150")
def _(t):
    e = F.col("event_type")
    rank = F.when(e == "error", 0).when(e == "view", 1).when(e == "signup", 2).otherwise(3)
    return t.events.orderBy(rank, "event_id").limit(150).select("event_id")


#: The fold in SQL: state (used bytes, count) carried along the ranks of each source.
_FOLD = """WITH RECURSIVE r AS (SELECT source, doc_id, n_chars AS size, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents),
 w(source, n, used, taken, stop, doc_id, got) AS (SELECT source, 0::BIGINT, 0::BIGINT, 0::BIGINT, false, 0::BIGINT, false FROM r WHERE n = 1
 UNION ALL SELECT r.source, r.n, CASE WHEN NOT w.stop AND w.taken < 40 AND w.used + r.size <= 24000 THEN w.used + r.size ELSE w.used END, CASE WHEN NOT w.stop AND w.taken < 40 AND w.used + r.size <= 24000 THEN w.taken + 1 ELSE w.taken END,
  w.stop OR w.taken >= 40 OR (w.used + r.size > 24000 AND 24000 - w.used < 200), r.doc_id, NOT w.stop AND w.taken < 40 AND w.used + r.size <= 24000 FROM w JOIN r ON r.source = w.source AND r.n = w.n + 1)
 SELECT source, doc_id, taken::INTEGER AS position FROM w WHERE got"""


@query("k9_byte_budget", _FOLD)
def _(t):
    return R.pack_to_budget(t.documents.select("source", "doc_id", "n_chars").withColumn("place", F.col("doc_id")), "source", "place", "n_chars", "doc_id", 24_000)


@query("k10_batches", """WITH RECURSIVE r AS (SELECT source, doc_id, n_chars AS size, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents WHERE n_chars <= 6000),
 w(source, n, batch, used, k, doc_id) AS (SELECT source, 1::BIGINT, 0, size, 1, doc_id FROM r WHERE n = 1 UNION ALL SELECT r.source, r.n, CASE WHEN w.used + r.size > 6000 OR w.k >= 4 THEN w.batch + 1 ELSE w.batch END,
  CASE WHEN w.used + r.size > 6000 OR w.k >= 4 THEN r.size ELSE w.used + r.size END, CASE WHEN w.used + r.size > 6000 OR w.k >= 4 THEN 1 ELSE w.k + 1 END, r.doc_id FROM w JOIN r ON r.source = w.source AND r.n = w.n + 1)
 SELECT source, doc_id, batch::INTEGER AS batch FROM w UNION ALL SELECT source, doc_id, -1 FROM documents WHERE n_chars > 6000""")
def _(t):
    return R.batches_by_size(t.documents.select("source", "doc_id", "n_chars").withColumn("place", F.col("doc_id")), "source", "place", "n_chars", "doc_id", 6000, 4)


@query("k11_prefix_trim", "SELECT source, doc_id FROM (SELECT source, doc_id, sum(n_chars) OVER (PARTITION BY source ORDER BY (lang <> 'en')::INT, doc_id ROWS UNBOUNDED PRECEDING) AS s FROM documents) WHERE s <= 20000")
def _(t):
    d = t.documents.select("source", "doc_id", "n_chars", (F.col("lang") != "en").alias("tier"))
    return R.prefix_within(d, ["source"], ["tier", "doc_id"], "n_chars", 20_000).select("source", "doc_id")


@query("k12_suggestions", "WITH s AS (SELECT 0 AS p, c_name AS label FROM customer WHERE c_acctbal < -995 UNION ALL SELECT 1, s_name FROM supplier WHERE s_acctbal < -900 UNION ALL SELECT 2, c_name FROM customer), d AS (SELECT label, min(p) AS p FROM s GROUP BY 1) SELECT label, p::INTEGER AS priority FROM d ORDER BY p, label LIMIT 7")
def _(t):
    a = t.customer.where("c_acctbal < -995").select(F.lit(0).alias("p"), F.col("c_name").alias("label"))
    b = t.supplier.where("s_acctbal < -900").select(F.lit(1), "s_name")
    c = t.customer.select(F.lit(2), "c_name")
    return a.unionAll(b).unionAll(c).groupBy("label").agg(F.min("p").alias("priority")).orderBy("priority", "label").limit(7)


@query("k13_seeded_shuffle", "SELECT c_custkey, sha256('seed|' || c_custkey) AS place FROM customer ORDER BY place LIMIT 100")
def _(t):
    place = F.sha2(F.concat(F.lit("seed|"), F.col("c_custkey").cast("string")), 256)
    return t.customer.select("c_custkey", place.alias("place")).orderBy("place").limit(100)


@query("k14_fit_budget", f"WITH {A.ENTITIES}, {A.CLOSURE}, o AS (SELECT 's' || s_suppkey AS id, row_number() OVER (ORDER BY s_suppkey) AS n FROM supplier), a AS (SELECT c.ancestor_id, min(o.n) AS n FROM closure c JOIN o ON o.id = c.id GROUP BY 1), p AS (SELECT n, sum(count(*)) OVER (ORDER BY n) AS s FROM a GROUP BY n) SELECT o.id FROM o JOIN p USING (n) WHERE s <= 60")
def _(t):
    e = A.entities(t)
    order = t.supplier.select(A.tag("s", "s_suppkey").alias("id"), F.col("s_suppkey").alias("n"))
    first = G.closure(e).join(order, "id").groupBy("ancestor_id").agg(F.min("n").alias("n"))
    steps = first.groupBy("n").agg(F.count("*").alias("c"))
    # A budget of 60 scopes can hold 60 steps at most: the prefix is summed over those alone.
    head = steps.orderBy("n").limit(60)
    w = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fits = head.withColumn("s", F.sum("c").over(w)).where("s <= 60")
    return order.join(fits, "n").select("id")


@query("g29_flow_selection", """WITH RECURSIVE o AS (SELECT o_orderpriority AS grp, o_orderkey::VARCHAR AS id, 'c' || (o_custkey % 9) AS a, 'c' || (o_custkey % 14) AS b, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey::VARCHAR) AS n FROM orders),
 w(grp, n, nodes, k, id, got) AS (SELECT grp, 0::BIGINT, []::VARCHAR[], 0, '', false FROM o WHERE n = 1 UNION ALL SELECT o.grp, o.n, CASE WHEN w.k < 8 AND len(list_distinct(list_concat(w.nodes, [o.a, o.b]))) <= 7 THEN list_distinct(list_concat(w.nodes, [o.a, o.b])) ELSE w.nodes END,
  CASE WHEN w.k < 8 AND len(list_distinct(list_concat(w.nodes, [o.a, o.b]))) <= 7 THEN w.k + 1 ELSE w.k END, o.id, w.k < 8 AND len(list_distinct(list_concat(w.nodes, [o.a, o.b]))) <= 7 FROM w JOIN o ON o.grp = w.grp AND o.n = w.n + 1)
 SELECT grp, id FROM w WHERE got""")
def _(t):
    o = t.orders.select(F.col("o_orderpriority").alias("grp"), F.col("o_orderkey").cast("string").alias("id"), F.concat(F.lit("c"), (F.col("o_custkey") % 9).cast("string")).alias("from_id"), F.concat(F.lit("c"), (F.col("o_custkey") % 14).cast("string")).alias("to_id"))
    return R.flows_within_caps(o, "grp", 8, 7)


@query("u1_union_names", "SELECT s_name AS name FROM supplier UNION SELECT c_name FROM customer UNION SELECT n_name FROM nation")
def _(t):
    return t.supplier.select(F.col("s_name").alias("name")).union(t.customer.select("c_name")).union(t.nation.select("n_name")).distinct()


@query("u2_key_difference", "SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'R' EXCEPT SELECT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'A'")
def _(t):
    # One group for each key tells the sides that it is on: one shuffle, and each task holds one table of keys.
    sides = t.lineitem.where("l_returnflag IN ('R', 'A')").groupBy("l_suppkey", "l_partkey").agg(F.bool_or(F.col("l_returnflag") == "A").alias("gone"))
    return sides.where("NOT gone").drop("gone")


@query("u3_intersection", "SELECT l_suppkey FROM lineitem WHERE l_quantity > 49 INTERSECT SELECT l_suppkey FROM lineitem WHERE l_discount > 0.09")
def _(t):
    return t.lineitem.where("l_quantity > 49").select("l_suppkey").intersect(t.lineitem.where("l_discount > 0.09").select("l_suppkey"))


@query("u4_partition", "WITH d AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'P'), s AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'O') SELECT CASE WHEN d.k IS NOT NULL THEN 'dirty' WHEN s.k IS NOT NULL THEN 'stale' ELSE 'reused' END AS part, count(*)::BIGINT AS n FROM customer LEFT JOIN d ON d.k = c_custkey LEFT JOIN s ON s.k = c_custkey GROUP BY 1")
def _(t):
    of = lambda s, name: t.orders.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias(name)).distinct()
    both = t.customer.join(of("P", "d"), F.col("c_custkey") == F.col("d"), "left").join(of("O", "s"), F.col("c_custkey") == F.col("s"), "left")
    part = F.when(F.col("d").isNotNull(), "dirty").when(F.col("s").isNotNull(), "stale").otherwise("reused")
    return both.groupBy(part.alias("part")).agg(F.count("*").alias("n"))


@query("u5_patch_sets", "SELECT k, CASE WHEN b IS NULL THEN 'remove' ELSE 'upsert' END AS op FROM (SELECT o_custkey AS k, max(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS a, max(o_totalprice) FILTER (WHERE o_orderstatus = 'O') AS b FROM orders GROUP BY 1) WHERE a IS DISTINCT FROM b AND (a IS NOT NULL OR b IS NOT NULL)")
def _(t):
    top = lambda s, n: t.orders.where(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias(f"k{n}")).agg(F.max("o_totalprice").alias(n))
    both = top("F", "a").join(top("O", "b"), F.col("ka") == F.col("kb"), "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))
    return both.select(F.coalesce("ka", "kb").alias("k"), F.when(F.col("b").isNull(), "remove").otherwise("upsert").alias("op"))

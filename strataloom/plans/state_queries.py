"""Stateful (R), spatial (P) and constraint (V) queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import adapters as A
from ..operators import claims as C
from ..operators import geometry
from ..operators import layout as L
from ..operators import spatial as P
from ..operators import validate as V
from ..operators.playback import sample_timelines
from ..streaming import stateful as R
from .registry import Tables, query

_LIMIT = """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
 w(user_id, n, event_id, start, used, ok) AS (SELECT user_id, n, event_id, t, 1, true FROM e WHERE n = 1 UNION ALL SELECT e.user_id, e.n, e.event_id, CASE WHEN e.t - w.start >= 86400 THEN e.t ELSE w.start END,
 CASE WHEN e.t - w.start >= 86400 THEN 1 WHEN w.used < 2 THEN w.used + 1 ELSE w.used END, e.t - w.start >= 86400 OR w.used < 2 FROM w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1)
 SELECT user_id, event_id, ok AS admitted FROM w"""


@query("r1_fixed_window_limiter", _LIMIT)
def _(t):
    return R.limiter(t.events, "user_id", "ts", "event_id", 86_400, 2)


@query("r2_debounce", "WITH g AS (SELECT user_id, ts, coalesce(epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) > 1800, true)::INT AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, max(ts) AS last, count(*)::BIGINT AS events FROM s GROUP BY user_id, k")
def _(t):
    return R.debounce(t.events, "user_id", "ts", 1800)


@query("r3_delivery_dedupe", "WITH e AS (SELECT event_id, user_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events), m AS (SELECT event_id, user_id, before, (SELECT count(DISTINCT x.user_id) FROM events x WHERE x.event_id > e.before AND x.event_id < e.event_id) AS others FROM e) SELECT event_id FROM m WHERE before IS NULL OR others >= 40")
def _(t):
    return R.dedupe_recent(t.events.select("event_id", "user_id"), "user_id", "event_id", 40, chunk_rows=4000).select("event_id")


@query("r4_daily_admission", "SELECT user_id, event_id, n <= 2 AS admitted FROM (SELECT *, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) AS n FROM events)")
def _(t):
    return R.admit_daily(t.events, "user_id", "ts", "event_id", 2).drop("day")


@query("r5_patches", "WITH b AS (SELECT c_custkey AS id, c_acctbal AS value, 0::BIGINT AS revision, 'upsert' AS op FROM customer), p AS (SELECT o_custkey AS id, o_totalprice AS value, o_orderkey + 1 AS revision, CASE WHEN o_orderstatus = 'P' THEN 'remove' ELSE 'upsert' END AS op FROM orders), l AS (SELECT id, arg_max(value, revision) AS value, max(revision) AS revision, arg_max(op, revision) AS op FROM (SELECT * FROM b UNION ALL SELECT * FROM p) GROUP BY 1) SELECT id, value, revision FROM l WHERE op <> 'remove'")
def _(t):
    base = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("value"))
    ops = t.orders.select(F.col("o_custkey").alias("id"), F.col("o_totalprice").alias("value"), (F.col("o_orderkey") + 1).alias("revision"), F.when(F.col("o_orderstatus") == "P", "remove").otherwise("upsert").alias("op"))
    return R.apply_patches(base, ops)


@query("r5b_patch_status", "WITH p AS (SELECT o_custkey AS scene, o_orderkey AS arrival, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, o_orderkey % 5 = 0 AS late FROM orders), q AS (SELECT *, count(*) FILTER (WHERE NOT late) OVER (PARTITION BY scene ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS made FROM p) SELECT arrival, CASE WHEN late AND made % 2 = 0 THEN 'revisionMismatch' WHEN late THEN 'nonIncreasing' ELSE 'applied' END AS status FROM q")
def _(t):
    # Each customer's orders are patches in a row; every fifth names a wrong base, or its base as the next revision.
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    late = F.col("o_orderkey") % 5 == 0
    at = F.coalesce(F.sum(F.when(late, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    p = t.orders.select(F.col("o_custkey").alias("scene"), F.col("o_orderkey").alias("arrival"), late.alias("late"), at.alias("at"))
    base = F.when(F.col("late") & (F.col("at") % 2 == 0), F.col("at") + 7).otherwise(F.col("at"))
    p = p.select("scene", "arrival", base.alias("base_revision"), F.when(F.col("late"), base).otherwise(F.col("at") + 1).alias("revision"))
    return R.patch_status(p).select("arrival", "status")


@query(
    "r6_lod_hysteresis",
    """WITH RECURSIVE e AS (SELECT user_id, event_id, value AS z, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events), w(user_id, n, event_id, level) AS (SELECT user_id, n, event_id, (z >= 30)::INT + (z >= 90)::INT FROM e WHERE n = 1
 UNION ALL SELECT e.user_id, e.n, e.event_id, CASE WHEN w.level = 0 THEN CASE WHEN z >= 95 THEN 2 WHEN z >= 35 THEN 1 ELSE 0 END WHEN w.level = 1 THEN CASE WHEN z >= 95 THEN 2 WHEN z < 25 THEN 0 ELSE 1 END ELSE CASE WHEN z < 25 THEN 0 WHEN z < 85 THEN 1 ELSE 2 END END FROM w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1)
 SELECT user_id, event_id, level FROM w""",
)
def _(t):
    return R.lod_levels(t.events, "user_id", "event_id", "value", (30.0, 90.0), 5.0)


_EASED = "CASE WHEN e = 'easeInOut' THEN CASE WHEN f < 0.5 THEN 4 * pow(f, 3) ELSE 1 - pow(2 - 2 * f, 3) / 2 END WHEN e = 'easeOut' THEN 1 - pow(1 - f, 4) ELSE f END"


@query(
    "r7_playback",
    f"""WITH r AS (SELECT user_id, event_id, event_type = 'purchase' AS k, epoch_us(ts) // 1000 - epoch_ms(TIMESTAMP '2024-01-01') AS o, value, event_id % 3 AS m FROM events),
 w AS (SELECT *, last_value(CASE WHEN k THEN struct_pack(o := o, v := value, i := event_id, m := m) END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY o, k, lpad(event_id::VARCHAR, 12, '0') ROWS UNBOUNDED PRECEDING) AS p,
  last_value(CASE WHEN k THEN struct_pack(o := o, v := value, i := event_id, m := m) END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY o DESC, k DESC, lpad(event_id::VARCHAR, 12, '0') DESC ROWS UNBOUNDED PRECEDING) AS n FROM r),
 s AS (SELECT user_id AS scene, event_id AS sample, o, p, n, coalesce(n, p) AS t FROM w WHERE NOT k),
 f AS (SELECT *, CASE t.m WHEN 0 THEN 'linear' WHEN 1 THEN 'easeInOut' ELSE 'easeOut' END AS e, CASE WHEN n IS NULL OR t.o <= coalesce(p.o, 0) THEN 1 ELSE greatest(0, least(1, (o - coalesce(p.o, 0)) / (t.o - coalesce(p.o, 0)))) END AS f FROM s),
 a AS (SELECT *, {_EASED} AS a FROM f)
SELECT scene, sample, lpad(t.i::VARCHAR, 12, '0') AS keyframe, t IS NOT NULL AND t.m <> 2 AS camera_active, round(CASE WHEN t.m <> 2 THEN coalesce(CASE WHEN p.m <> 2 THEN p.v END, 0) + (t.v - coalesce(CASE WHEN p.m <> 2 THEN p.v END, 0)) * a ELSE 0 END, 4) AS x,
 round(CASE WHEN t.m <> 2 THEN exp(ln(coalesce(CASE WHEN p.m <> 2 THEN 1 + p.v END, 1)) + (ln(1 + t.v) - ln(coalesce(CASE WHEN p.m <> 2 THEN 1 + p.v END, 1))) * a) ELSE 1 END, 4) AS zoom,
 round(coalesce(p.v, t.v) + (t.v - coalesce(p.v, t.v)) * a, 4) AS level FROM a""",
)
def _(t):
    e = t.events.withColumn("at_ms", F.unix_millis(F.col("ts").cast("timestamp")) - F.unix_millis(F.lit("2024-01-01").cast("timestamp"))).withColumnRenamed("user_id", "scene")
    mode = F.col("event_id") % 3
    camera = F.when(mode != 2, F.struct(F.col("value").alias("x"), F.lit(0.0).alias("y"), (1 + F.col("value")).alias("zoom")))
    easing = F.when(mode == 0, "linear").when(mode == 1, "easeInOut").otherwise("easeOut")
    key = e.where("event_type = 'purchase'").select("scene", F.lpad(F.col("event_id").cast("string"), 12, "0").alias("keyframe"), "at_ms", easing.alias("easing"), camera.alias("camera"), F.array("value").alias("level"))
    got = sample_timelines(key, e.where("event_type <> 'purchase'").select("scene", F.col("event_id").alias("sample"), "at_ms"))
    return got.select("scene", "sample", "keyframe", "camera_active", F.round("x", 4).alias("x"), F.round("zoom", 4).alias("zoom"), F.round(F.get("values", F.lit(0)), 4).alias("level"))


@query("r8_backoff", "SELECT o_orderkey, 0.5 * pow(2, o_orderkey % 6) AS pause FROM orders")
def _(t):
    return t.orders.select("o_orderkey", (F.lit(0.5) * F.pow(F.lit(2.0), F.col("o_orderkey") % 6)).alias("pause"))


@query("r9_thread_cap", "SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 3")
def _(t):
    return R.cap_threads(t.conversations, "conv_id", "turn", 3).select("conv_id", "turn")


@query("r10_rescan_carry", "WITH a AS (SELECT user_id, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) SELECT user_id, CASE WHEN bool_or(ok) FILTER (WHERE n = 1) THEN 'done' WHEN NOT coalesce(bool_or(ok) FILTER (WHERE n = 2), true) THEN 'drop' ELSE 'retry' END AS action FROM a GROUP BY 1")
def _(t):
    return R.carry_unfinished(t.events.withColumn("ok", F.col("event_type") != "error"), "user_id", "event_id", "ok")


@query("r11_reuse_hash", "SELECT count(*) FILTER (WHERE a = b)::BIGINT AS reused, count(*) FILTER (WHERE a <> b)::BIGINT AS mismatch, count(*) FILTER (WHERE b IS NULL)::BIGINT AS unknown FROM (SELECT sha256(text) AS a, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN sha256(lower(text)) ELSE sha256(text) END AS b FROM documents)")
def _(t):
    now = F.sha2("text", 256)
    then = F.when(F.col("doc_id") % 5 == 0, None).when(F.col("doc_id") % 7 == 0, F.sha2(F.lower("text"), 256)).otherwise(now)
    both = t.documents.select(now.alias("a"), then.alias("b"))
    return both.agg(F.count_if(F.col("a") == F.col("b")).alias("reused"), F.count_if(F.col("a") != F.col("b")).alias("mismatch"), F.count_if(F.col("b").isNull()).alias("unknown"))


@query("r13_zoom_sessions", "SELECT user_id, count(*) FILTER (WHERE up)::BIGINT AS rises, count(*)::BIGINT AS samples FROM (SELECT user_id, coalesce(value > lag(value) OVER (PARTITION BY user_id ORDER BY event_id), false) AS up FROM events) GROUP BY 1")
def _(t):
    up = F.coalesce(F.col("value") > F.lag("value").over(Window.partitionBy("user_id").orderBy("event_id")), F.lit(False))
    return t.events.select("user_id", up.alias("up")).groupBy("user_id").agg(F.count_if("up").alias("rises"), F.count("*").alias("samples"))


def _boxes(t: Tables):
    return t.part.select(F.col("p_partkey").alias("id"), (F.col("p_retailprice") * 10).alias("x"), (F.col("p_size") * 40.0).alias("y"), F.lit(12.0).alias("w"), F.lit(9.0).alias("h"), "p_brand")


_BOX = "b AS (SELECT p_partkey AS id, p_retailprice * 10 AS x, p_size * 40.0 AS y, 12.0 AS w, 9.0 AS h, p_brand FROM part)"


@query("p1_tile_ring", "SELECT tx::BIGINT AS tx, ty::BIGINT AS ty FROM range(0, 6) a(tx), range(-1, 4) b(ty)")
def _(t):
    return t.spark.createDataFrame(P.tile_ring((700, 100, 1500, 1000)), "tx long, ty long")


@query("p2_grid_index", f"WITH {_BOX}, c AS (SELECT id, unnest(range(floor(x / 512)::BIGINT, floor((x + w) / 512)::BIGINT + 1)) AS cx, y, h FROM b), d AS (SELECT id, cx, unnest(range(floor(y / 512)::BIGINT, floor((y + h) / 512)::BIGINT + 1)) AS cy FROM c) SELECT cx, cy, count(*)::BIGINT AS n FROM d GROUP BY 1, 2")
def _(t):
    return P.gridded(_boxes(t), 512.0)[0].groupBy("cx", "cy").agg(F.count("*").alias("n"))


@query("p3_range_query", f"WITH {_BOX} SELECT id FROM b WHERE x < 12000 AND x + w > 10000 AND y < 900 AND y + h > 200")
def _(t):
    view = (10_000.0, 200.0, 2_000.0, 700.0)
    cells = P.gridded(_boxes(t), 512.0)[0]
    keys = t.spark.createDataFrame(P.tile_ring(view, 512, 0), "cx long, cy long")
    box = {c: F.col(c) for c in ("x", "y", "w", "h")}
    return cells.join(keys, ["cx", "cy"], "left_semi").where(P.rect_overlaps(box, view)).select("id").distinct()


@query("p4_hit_test", f"WITH {_BOX} SELECT id, z FROM (SELECT id, id % 5 AS z, pow(greatest(x - 11000, 11000 - (x + w), 0), 2) + pow(greatest(y - 440, 440 - (y + h), 0), 2) AS d FROM b) WHERE d <= 90000 ORDER BY z DESC, d, id DESC LIMIT 1")
def _(t):
    return P.hit_test(_boxes(t).withColumn("z", F.col("id") % 5), 11_000.0, 440.0, 300.0).select("id", "z")


@query("p5_resident_set", f"WITH {_BOX} SELECT id FROM b WHERE id % 700 = 3 UNION ALL (SELECT id FROM b WHERE id % 700 <> 3 AND x < 12000 AND x + w > 10000 AND y < 900 AND y + h > 200 ORDER BY (x + w / 2 - 11000) * (x + w / 2 - 11000) + (y + h / 2 - 550) * (y + h / 2 - 550), id LIMIT 40 - (SELECT count(*) FROM b WHERE id % 700 = 3))")
def _(t):
    b = _boxes(t)
    return P.resident(b, (10_000.0, 200.0, 2_000.0, 700.0), b.where("id % 700 = 3").select("id"), 40).select("id")


_DRAWING = """k AS (SELECT p_partkey AS k, p_partkey // 40 AS scene, p_size AS z FROM part),
 e AS (SELECT scene, 'e' || k AS id, k % 2 = 0 AS flat, CASE WHEN k % 2 = 0 THEN 5 * (k % 11) ELSE 10 * (z % 13) + k % 3 END AS x, CASE WHEN k % 2 = 0 THEN 10 * (z % 13) ELSE 5 * (k % 7) END AS y, 4 + 6 * (z % 20) AS len FROM k),
 r AS (SELECT *, x + CASE WHEN flat THEN len ELSE 0 END AS x1, y + CASE WHEN flat THEN 0 ELSE len END AS y1 FROM e),
 n AS (SELECT scene, 'n' || k AS id, 10 * (z % 9) AS x, 10 * (k % 9) AS y, 50 + z AS w, 30 + k % 40 AS h FROM k),
 l AS (SELECT scene, 'l' || k AS id, 'e' || k AS own, 7 * (z % 15) AS x, 7 * (k % 15) AS y, 12 AS w, 6 AS h FROM k),
 b AS (SELECT scene, id, TRUE AS flat, unnest([y, y + h]) AS at, x AS lo, x + w AS hi FROM n UNION ALL SELECT scene, id, FALSE, unnest([x, x + w]), y, y + h FROM n),
 f AS (SELECT a.scene, 'edge-crossing' AS kind, least(a.len, c.len)::DOUBLE AS length, NULL::DOUBLE AS distance FROM r a JOIN r c ON a.scene = c.scene AND a.flat AND NOT c.flat AND a.x < c.x AND c.x < a.x1 AND c.y < a.y AND a.y < c.y1
  UNION ALL SELECT a.scene, 'shared-corridor', least(CASE WHEN a.flat THEN a.x1 ELSE a.y1 END, CASE WHEN a.flat THEN c.x1 ELSE c.y1 END) - greatest(CASE WHEN a.flat THEN a.x ELSE a.y END, CASE WHEN a.flat THEN c.x ELSE c.y END) AS o, CASE WHEN a.flat THEN abs(a.y - c.y) ELSE abs(a.x - c.x) END AS d
   FROM r a JOIN r c ON a.scene = c.scene AND a.flat = c.flat AND a.id < c.id WHERE d <= 2 AND o > 0
  UNION ALL SELECT a.scene, 'container-border-run', least(b.hi, CASE WHEN a.flat THEN a.x1 ELSE a.y1 END) - greatest(b.lo, CASE WHEN a.flat THEN a.x ELSE a.y END) AS o, abs(b.at - CASE WHEN a.flat THEN a.y ELSE a.x END) AS d
   FROM r a JOIN b ON a.scene = b.scene AND a.flat = b.flat WHERE d <= 3 AND o >= 48
  UNION ALL SELECT l.scene, 'label-clearance', NULL, sqrt(pow(greatest(c.x - l.x - l.w, 0, l.x - c.x1), 2) + pow(greatest(c.y - l.y - l.h, 0, l.y - c.y1), 2)) AS d FROM l JOIN r c ON l.scene = c.scene AND l.own <> c.id WHERE d <= 4
  UNION ALL SELECT l.scene, 'label-clearance', NULL, sqrt(pow(greatest(n.x - l.x - l.w, 0, l.x - n.x - n.w), 2) + pow(greatest(n.y - l.y - l.h, 0, l.y - n.y - n.h), 2)) AS d FROM l JOIN n ON l.scene = n.scene WHERE d <= 4
  UNION ALL SELECT scene, 'short-route', len, NULL FROM r WHERE len < 16)"""


@query("p6_geometry_findings", f"WITH {_DRAWING} SELECT scene, kind, count(*)::BIGINT AS n, round(sum(length), 2) AS length, round(sum(round(distance, 3)), 2) AS distance FROM f GROUP BY 1, 2")
def _(t):
    # Drawings of forty parts each: straight routes, cards and labels; bends, ports and exemptions are left to the tests.
    d = A.dealt(t.part).select(F.col("p_partkey").alias("k"), F.floor(F.col("p_partkey") / 40).alias("scene"), F.col("p_size").alias("z"))
    flat, far = F.col("k") % 2 == 0, 4 + 6 * (F.col("z") % 20)
    x, y = F.when(flat, 5 * (F.col("k") % 11)).otherwise(10 * (F.col("z") % 13) + F.col("k") % 3), F.when(flat, 10 * (F.col("z") % 13)).otherwise(5 * (F.col("k") % 7))
    at = lambda a, b: F.struct(a.cast("double").alias("x"), b.cast("double").alias("y"))
    none = F.lit(None).cast("string")
    box = lambda *xs: [c.cast("double").alias(n) for c, n in zip(xs, ("x", "y", "width", "height"))]
    edges = d.select("scene", A.tag("e", "k").alias("id"), none.alias("from_id"), none.alias("to_id"), none.alias("bundle"), F.array(at(x, y), at(x + F.when(flat, far).otherwise(0), y + F.when(flat, 0).otherwise(far))).alias("points"))
    nodes = d.select("scene", A.tag("n", "k").alias("id"), none.alias("parent_id"), *box(10 * (F.col("z") % 9), 10 * (F.col("k") % 9), 50 + F.col("z"), 30 + F.col("k") % 40))
    labels = d.select("scene", A.tag("l", "k").alias("id"), A.tag("e", "k").alias("edge_id"), *box(7 * (F.col("z") % 15), 7 * (F.col("k") % 15), F.lit(12), F.lit(6)))
    found = geometry.geometry_findings(nodes, edges, labels)
    return found.groupBy("scene", "kind").agg(F.count("*").alias("n"), F.round(F.sum("length"), 2).alias("length"), F.round(F.sum("distance"), 2).alias("distance"))


def _levels_sql(leaf: tuple[int, int], pad: int, gap: int) -> str:
    """CTEs of the sizes of each level of the tree, s3 up to s0."""
    out = [f"s3 AS (SELECT id, parent_id, {leaf[0]} AS w, {leaf[1]} AS h FROM entities WHERE rank = 3)"]
    for k in (2, 1, 0):
        c = k + 1
        out.append(f"i{c} AS (SELECT *, row_number() OVER (PARTITION BY parent_id ORDER BY id) - 1 AS i, least(3, ceil(sqrt(count(*) OVER (PARTITION BY parent_id))))::INT AS c FROM s{c})")
        side = lambda cell, size: f"(SELECT parent_id AS p, sum(m) + {gap} * (count(*) - 1) + 2 * {pad} AS m FROM (SELECT parent_id, {cell} AS g, max({size}) AS m FROM i{c} GROUP BY 1, 2) GROUP BY 1)"  # noqa: B023, E731
        out.append(f"s{k} AS (SELECT e.id, e.parent_id, coalesce(x.m, {leaf[0]}) AS w, coalesce(y.m, {leaf[1]}) AS h FROM entities e LEFT JOIN {side('i % c', 'w')} x ON x.p = e.id LEFT JOIN {side('i // c', 'h')} y ON y.p = e.id WHERE rank = {k})")
    return ", ".join(out)


@query("p7_containment_sizes", f"WITH {A.ENTITIES}, {_levels_sql((30, 20), 8, 4)} SELECT id, w::DOUBLE AS width, h::DOUBLE AS height FROM (SELECT * FROM s0 UNION ALL SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3)")
def _(t):
    return L.containment_layout(A.entities(t), (30, 20), 8, 4).select("id", "width", "height")


@query(
    "p8_grid_packing",
    "WITH i AS (SELECT n_regionkey AS p, n_name AS id, 10.0::DOUBLE + n_nationkey % 4 AS w, 5.0::DOUBLE + n_nationkey % 3 AS h, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) - 1 AS k, least(3, ceil(sqrt(count(*) OVER (PARTITION BY n_regionkey))))::INT AS c FROM nation), g AS (SELECT *, k % c AS col, k // c AS row FROM i),"
    " cw AS (SELECT p, col, max(w) AS m FROM g GROUP BY 1, 2), rh AS (SELECT p, row, max(h) AS m FROM g GROUP BY 1, 2), cx AS (SELECT *, coalesce(sum(m + 2) OVER (PARTITION BY p ORDER BY col ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM cw), ry AS (SELECT *, coalesce(sum(m + 2) OVER (PARTITION BY p ORDER BY row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM rh)"
    " SELECT g.id, g.col::INTEGER AS col, g.row::INTEGER AS row, cx.b + (cx.m - w) / 2 AS at_x, ry.b + (ry.m - h) / 2 AS at_y FROM g JOIN cx ON cx.p = g.p AND cx.col = g.col JOIN ry ON ry.p = g.p AND ry.row = g.row",
)
def _(t):
    n = t.nation
    items = n.select(F.col("n_regionkey").alias("owner"), F.col("n_name").alias("id"), (F.lit(10.0) + F.col("n_nationkey") % 4).alias("width"), (F.lit(5.0) + F.col("n_nationkey") % 3).alias("height"))
    return L.grid(items, "owner", 2.0).select("id", F.col("col").cast("int").alias("col"), "row", "at_x", "at_y")


@query("p9_orthogonal_routes")
def _(t):
    k = F.col("n_nationkey")
    edges = t.nation.select(k.alias("id"), F.col("n_regionkey").alias("scene"), F.lit(0).alias("x1"), (k % 8).alias("y1"), F.lit(9).alias("x2"), ((k * 3) % 8).alias("y2"))
    walls = t.nation.select(F.col("n_regionkey").alias("scene"), (1 + k % 7).alias("x"), (k % 8).alias("y")).where("x > 0 AND x < 9")
    return P.routes(edges, walls, (10, 8))


@query("p10_scene_objects", f"WITH {A.ENTITIES} SELECT id, parent_id, kind, 12.0::DOUBLE * (4 - rank) AS width FROM entities WHERE rank <= 2")
def _(t):
    return A.entities(t).where("rank <= 2").select("id", "parent_id", "kind", (F.lit(12.0) * (4 - F.col("rank"))).alias("width"))


@query("p12_envelope", f"WITH {_BOX} SELECT min(x) AS x, min(y)::DOUBLE AS y, max(x + w) - min(x) AS w, (max(y + h) - min(y))::DOUBLE AS h FROM b")
def _(t):
    return P.envelope(_boxes(t))


_BROKEN = "e AS (SELECT 'n' || n_nationkey AS id, CASE WHEN n_nationkey % 9 = 4 THEN 'gadget' ELSE 'component' END AS kind, CASE n_nationkey WHEN 3 THEN 'n4' WHEN 4 THEN 'n3' WHEN 5 THEN 'n5' WHEN 6 THEN 'nowhere' END AS parent_id FROM nation UNION ALL SELECT 'n1', 'component', NULL), r AS (SELECT 'l' || n_nationkey AS id, 'n' || n_nationkey AS from_id, 'n' || (n_nationkey + 3) AS to_id, CASE WHEN n_nationkey % 8 = 0 THEN 'duplicates' ELSE 'uses' END AS kind FROM nation)"


def _broken(t: Tables):
    k = F.col("n_nationkey")
    parent = F.when(k == 3, "n4").when(k == 4, "n3").when(k == 5, "n5").when(k == 6, "nowhere")
    e = t.nation.select(A.tag("n", "n_nationkey").alias("id"), F.when(k % 9 == 4, "gadget").otherwise("component").alias("kind"), parent.alias("parent_id"))
    e = e.unionAll(t.spark.createDataFrame([("n1", "component", None)], "id string, kind string, parent_id string"))
    r = t.nation.select(A.tag("l", "n_nationkey").alias("id"), A.tag("n", "n_nationkey").alias("from_id"), F.concat(F.lit("n"), (k + 3).cast("string")).alias("to_id"), F.when(k % 8 == 0, "duplicates").otherwise("uses").alias("kind"))
    return e, r


@query(
    "v1_snapshot_rules",
    f"WITH {_BROKEN} SELECT 'entities/' || id AS path, 'duplicate id' AS message FROM e GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'entities/' || id, 'unknown parent_id' FROM e WHERE parent_id NOT IN (SELECT id FROM e) UNION ALL SELECT 'relations/' || id, 'unknown to_id' FROM r WHERE to_id NOT IN (SELECT id FROM e)"
    " UNION ALL SELECT 'entities/' || id, 'unknown kind' FROM e WHERE kind = 'gadget' UNION ALL SELECT 'entities/' || id, 'contains itself' FROM e WHERE id = parent_id UNION ALL SELECT 'entities/' || id, 'containment cycle' FROM e WHERE id IN ('n3', 'n4', 'n5') UNION ALL SELECT 'relations/' || r.id, 'duplicates joins code only' FROM r JOIN e a ON a.id = from_id JOIN e b ON b.id = to_id WHERE r.kind = 'duplicates'",
)
def _(t):
    return V.snapshot(*_broken(t))


@query(
    "v2_view_rules",
    f"WITH {A.ENTITIES}, {A.RELATIONS}, shown AS (SELECT 'n' || (n_nationkey + 5) AS id FROM nation UNION ALL SELECT 'n7' UNION ALL SELECT 's' || s_suppkey FROM supplier), nodes AS (SELECT 'n' || n_nationkey AS id, n_nationkey % 4 AS w FROM nation UNION ALL SELECT 's' || s_suppkey, 5 FROM supplier), edges AS (SELECT id FROM relations WHERE to_id = 's1' UNION ALL SELECT 'lost')"
    " SELECT 'root/sys' AS path, 'is not shown' AS message UNION ALL SELECT 'shown/' || id, 'duplicate id' FROM shown GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'shown/' || id, 'unknown entity' FROM shown WHERE id NOT IN (SELECT id FROM entities) UNION ALL SELECT 'nodes/' || id, 'has no place' FROM shown WHERE id NOT IN (SELECT id FROM nodes)"
    " UNION ALL SELECT 'nodes/' || id, 'is not shown' FROM nodes WHERE id NOT IN (SELECT id FROM shown) UNION ALL SELECT 'nodes/' || id, 'bad rectangle' FROM nodes WHERE w <= 0 UNION ALL SELECT 'edges/lost', 'unknown relation' UNION ALL SELECT 'edges/' || id, 'ends are not shown' FROM relations WHERE to_id = 's1'"
    " UNION ALL SELECT 'routes/other', 'is not shown' UNION ALL SELECT 'routes/other', 'needs two points'",
)
def _(t):
    r = A.relations(t)
    number = lambda *ids: t.spark.createDataFrame([(i,) for i in ids], "id string")
    suppliers = t.supplier.select(A.tag("s", "s_suppkey").alias("id"))
    shown = t.nation.select(F.concat(F.lit("n"), (F.col("n_nationkey") + 5).cast("string")).alias("id")).unionAll(number("n7")).unionAll(suppliers)
    nodes = t.nation.select(A.tag("n", "n_nationkey").alias("id"), (F.col("n_nationkey") % 4).alias("width")).unionAll(suppliers.withColumn("width", F.lit(5)))
    nodes = nodes.select("id", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), "width", F.lit(1).alias("height"))
    edges = r.where("to_id = 's1'").select("id").unionAll(number("lost"))
    return V.view(A.entities(t), r, shown, edges, nodes, number("other").withColumn("points", F.lit(1)), "sys")


_GATE = """e AS (SELECT 'component:p-' || p_partkey AS id, CASE WHEN p_partkey % 11 = 0 THEN 'gadget' ELSE 'component' END AS kind, CASE WHEN p_partkey % 13 = 0 THEN NULL WHEN p_partkey % 17 = 0 THEN 'component:p-1' WHEN p_partkey % 19 = 0 THEN 'nowhere' ELSE 'container:c' END AS parent_id,
 CASE WHEN p_partkey % 7 = 0 THEN '  ' ELSE repeat('n', 100 + p_size * 2) END AS name FROM part UNION ALL SELECT 'container:c', 'container', 'system:s', 'c' UNION ALL SELECT 'system:s', 'softwareSystem', NULL, 's' UNION ALL SELECT 'Bad', 'person', 'system:s', 'b'),
 r AS (SELECT 'relation:r-' || s_suppkey AS id, 'component:p-1' AS from_id, CASE WHEN s_suppkey % 3 = 0 THEN 'component:p-1' WHEN s_suppkey % 5 = 0 THEN 'gone' ELSE 'container:c' END AS to_id, CASE WHEN s_suppkey % 2 = 0 THEN 'calls' ELSE 'contains' END AS kind, (s_suppkey % 70)::BIGINT AS evidence FROM supplier)"""


@query(
    "v3_extraction_gate",
    f"WITH {_GATE} SELECT 'entities/' || id AS path, 'unknown kind' AS message FROM e WHERE kind = 'gadget' UNION ALL SELECT 'entities/Bad', 'malformed id' UNION ALL SELECT 'entities/Bad', 'must be at the top' UNION ALL SELECT 'entities/' || id, 'name is missing or too long' FROM e WHERE trim(name) = '' OR length(name) > 160"
    " UNION ALL SELECT 'entities/' || id, 'needs a parent' FROM e WHERE kind = 'component' AND parent_id IS NULL UNION ALL SELECT 'entities/' || id, 'unknown parent_id' FROM e WHERE parent_id = 'nowhere' UNION ALL SELECT 'entities/' || id, 'wrong kind of parent' FROM e WHERE kind = 'component' AND parent_id = 'component:p-1'"
    " UNION ALL SELECT 'entities/' || id, 'must be at the top' FROM e WHERE kind = 'gadget' AND parent_id IS NOT NULL UNION ALL SELECT 'relations/' || id, 'unknown to_id' FROM r WHERE to_id = 'gone' UNION ALL SELECT 'relations/' || id, 'joins an entity with itself' FROM r WHERE from_id = to_id AND kind <> 'calls'"
    " UNION ALL SELECT 'relations/' || id, 'has no evidence' FROM r WHERE evidence = 0 UNION ALL SELECT 'relations/' || id, 'has too much evidence' FROM r WHERE evidence > 64 UNION ALL SELECT 'relations/' || id, 'repeats the hierarchy' FROM r WHERE kind = 'contains' AND to_id = 'container:c'",
)
def _(t):
    k = F.col("p_partkey")
    parent = F.when(k % 13 == 0, None).when(k % 17 == 0, "component:p-1").when(k % 19 == 0, "nowhere").otherwise("container:c")
    e = t.part.select(A.tag("component:p-", "p_partkey").alias("id"), F.when(k % 11 == 0, "gadget").otherwise("component").alias("kind"), parent.alias("parent_id"), F.when(k % 7 == 0, "  ").otherwise(F.repeat(F.lit("n"), 100 + F.col("p_size") * 2)).alias("name"))
    top = [("container:c", "container", "system:s", "c"), ("system:s", "softwareSystem", None, "s"), ("Bad", "person", "system:s", "b")]
    e = e.unionAll(t.spark.createDataFrame(top, "id string, kind string, parent_id string, name string")).withColumn("responsibility", F.lit(None).cast("string"))
    s = F.col("s_suppkey")
    to = F.when(s % 3 == 0, "component:p-1").when(s % 5 == 0, "gone").otherwise("container:c")
    r = t.supplier.select(A.tag("relation:r-", "s_suppkey").alias("id"), F.lit("component:p-1").alias("from_id"), to.alias("to_id"), F.when(s % 2 == 0, "calls").otherwise("contains").alias("kind"), F.lit("l").alias("label"), F.lit("t").alias("technology"), (s % 70).alias("evidence"))
    return V.extraction(e, r)


@query(
    "v4_dependency_facts",
    "WITH m AS (SELECT 'pkg/' || s_suppkey || CASE WHEN s_suppkey % 20 = 0 THEN '/../x' ELSE '' END AS manifest, s_suppkey AS id FROM supplier) SELECT 'packages/' || id AS path, 'unsafe path' AS message FROM m WHERE id % 20 = 0 UNION ALL SELECT 'packages/' || id, 'unknown ecosystem' FROM m WHERE id % 7 = 0"
    " UNION ALL SELECT 'declarations/' || p_partkey, 'unknown declared_in' FROM part WHERE 'pkg/' || p_partkey % 150 NOT IN (SELECT manifest FROM m) UNION ALL SELECT 'declarations/' || p_partkey, 'dependency is missing' FROM part WHERE p_partkey % 9 = 0 UNION ALL SELECT 'declarations/' || p_partkey, 'line must be positive' FROM part WHERE p_size < 3"
    " UNION ALL SELECT 'imports/' || o_orderkey, 'unknown imported_by' FROM orders WHERE 'pkg/' || o_custkey % 150 NOT IN (SELECT manifest FROM m) UNION ALL SELECT 'imports/' || o_orderkey, 'bad lines' FROM orders WHERE o_orderkey % 6 = 0",
)
def _(t):
    s, p, o = F.col("s_suppkey"), F.col("p_partkey"), F.col("o_orderkey")
    packages = t.supplier.select(s.alias("id"), F.when(s % 7 == 0, "pip").otherwise("npm").alias("ecosystem"), F.col("s_name").alias("name"), F.concat(F.lit("pkg/"), s.cast("string"), F.when(s % 20 == 0, "/../x").otherwise("")).alias("manifest"))
    at = lambda c: F.concat(F.lit("pkg/"), (F.col(c) % 150).cast("string"))
    declarations = t.part.select(p.alias("id"), F.lit("npm").alias("ecosystem"), F.when(p % 9 == 0, " ").otherwise(F.col("p_name")).alias("dependency"), at("p_partkey").alias("declared_in"), (F.col("p_size") - 2).alias("line"))
    imports = t.orders.select(o.alias("id"), F.lit("cargo").alias("ecosystem"), F.col("o_orderpriority").alias("dependency"), F.lit("src/a.rs").alias("path"), at("o_custkey").alias("imported_by"), F.lit(5).alias("start_line"), F.when(o % 6 == 0, 4).otherwise(5).alias("end_line"))
    return V.dependency_facts(packages, declarations, imports)


@query("v6_notation_completeness", "SELECT 'supplier/' || s_suppkey AS path, 'no balance' AS message FROM supplier WHERE s_acctbal < 0 UNION ALL SELECT 'supplier/' || s_suppkey, 'name is blank' FROM supplier WHERE trim(s_name) = ''")
def _(t):
    return V.all_of(V.holds(t.supplier, "supplier", "s_suppkey", F.col("s_acctbal") >= 0, "no balance"), V.holds(t.supplier, "supplier", "s_suppkey", F.trim("s_name") != "", "name is blank"))


@query("v8_strictly_increasing", "SELECT 'events/' || event_id AS path, 'value must increase' AS message FROM (SELECT event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) WHERE b >= value")
def _(t):
    return V.increasing(t.events, "events", ["user_id"], "value", "event_id")


@query("v9_enrichment_gate", "SELECT source, count(*)::BIGINT AS accepted FROM documents WHERE source NOT IN (SELECT source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 AND quality = 0) GROUP BY 1")
def _(t):
    bad = t.documents.join(t.labels.where("toxic = 1 AND quality = 0"), "doc_id").select("source")
    return V.accepted(t.documents, bad, "source").groupBy("source").agg(F.count("*").alias("accepted"))


_SENTENCE = "contains(summary, '. ' || first || ' ') OR contains(summary, '! ' || first || ' ') OR contains(summary, '? ' || first || ' ')"


@query(
    "v10_claim_revalidation",
    f"""WITH d AS (SELECT doc_id, lang, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS summary FROM documents),
 f AS (SELECT *, coalesce(nullif(regexp_extract(summary, '^[^.!?]*[.!?]', 0), ''), summary) AS first FROM d),
 s AS (SELECT *, length(first) >= 12 AND (first = summary OR substr(summary, length(first) + 1, 1) = ' ' OR {_SENTENCE} OR ends_with(summary, '. ' || first) OR ends_with(summary, '! ' || first) OR ends_with(summary, '? ' || first)) AS whole FROM f)
SELECT doc_id, v.position, CASE WHEN v.state = 'sentence?' THEN CASE WHEN whole THEN 'valid' ELSE 'sentence' END ELSE v.state END AS state
 FROM s, (VALUES (0, 'sentence?'), (1, 'valid'), (2, 'key point'), (3, 'id'), (4, 'evidence'), (5, 'malformed')) v(position, state)""",
)
def _(t):
    d = t.documents.select("doc_id", "lang", C.collapsed(F.col("text")).alias("summary"))
    first = F.coalesce(F.nullif(F.regexp_extract("summary", r"^[^.!?]*[.!?]", 0), F.lit("")), F.col("summary"))
    ref = F.struct(A.tag("d", "doc_id").alias("entity_id"), F.concat(F.lit("texts/"), F.col("doc_id").cast("string")).alias("path"), F.lit(1).alias("start_line"), F.lit(2).alias("end_line"))

    def claim(text, origin: str, index: int, evidence=F.array(ref), named=None):
        ident = C.claim_id(F.lit(named or origin), text, evidence)
        return F.struct(ident.alias("id"), text.alias("text"), F.lit(origin).alias("origin"), F.lit(index).alias("index"), evidence.alias("evidence"))

    lang = F.col("lang")
    claims = F.array(claim(first, "summary", 0), claim(lang, "keyPoint", 0), claim(lang, "keyPoint", 1), claim(lang, "keyPoint", 0, named="summary"), claim(lang, "keyPoint", 0, F.array_repeat(ref, 4)), claim(lang, "hearsay", 0))
    rows = d.select(F.col("doc_id").alias("id"), "summary", F.array(lang, F.concat(lang, F.lit("!"))).alias("key_points"), claims.alias("claims"))
    return C.revalidate(rows).select(F.col("id").alias("doc_id"), "position", "state")


@query("v11_excerpt_integrity", "SELECT l_orderkey, l_linenumber, count(*)::BIGINT AS n, bool_and(CASE l_partkey % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN false ELSE false END) AS matches FROM lineitem GROUP BY 1, 2")
def _(t):
    m, n = F.col("l_partkey") % 5, F.col("l_linenumber")
    # 0: whole; 1: another revision; 2: cut from a longer range; 3: cut, but the reference tells the cut; 4: half a range.
    excerpt = F.struct(F.lit("a").alias("path"), F.when(m == 1, "old").otherwise("new").alias("revision"), F.lit("s").alias("symbol"), n.alias("start"), (n + 4).alias("end"), F.when(m >= 2, F.greatest(n - 1, F.lit(1))).alias("source_start"), F.when(m.isin(2, 3), n + 9).alias("source_end"))
    ref = F.struct(F.lit("a").alias("path"), F.lit("new").alias("revision"), F.lit("s").alias("symbol"), F.when(m == 2, F.greatest(n - 1, F.lit(1))).otherwise(n).alias("start"), F.when(m == 2, n + 9).otherwise(n + 4).alias("end"))
    ok = t.lineitem.select("l_orderkey", "l_linenumber", V.excerpt_matches(excerpt, ref).alias("ok"))
    return ok.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), F.bool_and("ok").alias("matches"))


@query("v14_block_omissions", "SELECT o_orderkey, CASE WHEN o_totalprice IS NULL THEN 'empty' WHEN o_totalprice < 1000 THEN 'thin' WHEN o_orderpriority = '5-LOW' THEN 'unranked' END AS reason FROM orders WHERE o_totalprice < 1000 OR o_orderpriority = '5-LOW'")
def _(t):
    reason = F.when(F.col("o_totalprice").isNull(), "empty").when(F.col("o_totalprice") < 1000, "thin").when(F.col("o_orderpriority") == "5-LOW", "unranked")
    return t.orders.select("o_orderkey", reason.alias("reason")).where("reason IS NOT NULL")

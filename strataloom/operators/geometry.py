"""Findings of drawings: routes that cross, share a line, run along borders, crowd at ends or come too close to labels.

Scenes are tables: nodes (scene, id, parent_id, x, y, width, height), edges (scene, id, from_id, to_id, bundle, points) and labels
(scene, id, edge_id, x, y, width, height). What may touch is found by a grid of several levels: an item is kept in the few
cells of the level of its own size, so neither a long line nor a crowd of small things makes many rows.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import closure, shared

#: Fixed values, in pixels of the screen: what is hidden, what is one line, what is close, and what is short.
HIDDEN, COLLINEAR, LABEL_GAP, BORDER_GAP, BORDER_RUN, PORT_GAP, PORT_RADIUS, ROUTE, LEG = 2, 2, 4, 3, 48, 8, 16, 16, 6
#: Lengths below this, in units of the drawing, are none.
EPS = 1e-6


def _merged(df: DataFrame) -> DataFrame:
    """Shared rows that grow with the drawings: the planner takes them for small, so they ask to be merged, never broadcast."""
    return shared(df).hint("merge")


def _point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def _gap(a: Column, b: Column) -> Column:
    return F.hypot(a["x"] - b["x"], a["y"] - b["y"])


def _cross(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return ax * by - ay * bx


def clean_points(points: Column) -> Column:
    """Points without repeats, and without those in the middle of a straight way."""

    def step(out: Column, p: Column) -> Column:
        last, prev = F.get(out, F.size(out) - 1), F.get(out, F.size(out) - 2)
        ax, ay, bx, by = last["x"] - prev["x"], last["y"] - prev["y"], p["x"] - last["x"], p["y"] - last["y"]
        straight = (F.abs(_cross(ax, ay, bx, by)) <= 1e-12 * F.hypot(ax, ay) * F.hypot(bx, by)) & (ax * bx + ay * by > 0)
        same = (last["x"] == p["x"]) & (last["y"] == p["y"])
        return F.when(F.coalesce(same, F.lit(False)), out).when(F.coalesce(straight, F.lit(False)), F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(p))).otherwise(F.concat(out, F.array(p)))

    plain = F.transform(points, lambda p: _point(p["x"].cast("double"), p["y"].cast("double")))
    return F.aggregate(plain, F.array().cast("array<struct<x: double, y: double>>"), step)


def _routes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(scene, edge, from_id, to_id, bundle, pts, ports): ends that are no node of the scene are null."""
    known = nodes.select("scene", F.col("id").alias("n"))
    side = lambda df, end: df.join(known.select(F.col("scene").alias("k_scene"), F.col("n").alias(f"k_{end}")), (F.col("scene") == F.col("k_scene")) & (F.col(f"{end}_id") == F.col(f"k_{end}")), "left").drop("k_scene", f"{end}_id").withColumnRenamed(f"k_{end}", f"{end}_id")
    r = side(side(edges.select("scene", F.col("id").alias("edge"), "from_id", "to_id", "bundle", clean_points(F.col("points")).alias("pts")), "from"), "to")
    port = lambda node, i: F.struct(F.col(node).alias("node"), F.get("pts", i).alias("p"))
    return r.withColumn("ports", F.filter(F.array(port("from_id", F.lit(0)), port("to_id", F.size("pts") - 1)), lambda x: x["node"].isNotNull() & x["p"].isNotNull()))


def _segments(routes: DataFrame) -> DataFrame:
    """(scene, edge, ..., i, a, b, prev, first, last, len, axis) of the legs of routes."""
    legs = F.transform(F.sequence(F.lit(0), F.size("pts") - 2), lambda i: F.struct(i.alias("i"), F.get("pts", i).alias("a"), F.get("pts", i + 1).alias("b"), F.get("pts", i - 1).alias("prev")))
    s = routes.where(F.size("pts") >= 2).withColumn("n", F.size("pts") - 1).select("scene", "edge", "from_id", "to_id", "bundle", "ports", "n", F.explode(legs).alias("s")).select("*", "s.*").drop("s")
    axis = F.when(F.abs(F.col("a.y") - F.col("b.y")) <= EPS, "h").when(F.abs(F.col("a.x") - F.col("b.x")) <= EPS, "v")
    return s.select("*", (F.col("i") == 0).alias("first"), (F.col("i") == F.col("n") - 1).alias("last"), _gap(F.col("a"), F.col("b")).alias("len"), axis.alias("axis")).drop("n")


def _boxed(df: DataFrame, x0: Column, y0: Column, x1: Column, y1: Column, pad: float) -> DataFrame:
    return df.withColumn("box", F.struct((x0 - pad).alias("x0"), (y0 - pad).alias("y0"), (x1 + pad).alias("x1"), (y1 + pad).alias("y1")))


def _segment_boxes(s: DataFrame, pad: float) -> DataFrame:
    ends = lambda f, c: f(F.col(f"a.{c}"), F.col(f"b.{c}"))
    return _boxed(s, ends(F.least, "x"), ends(F.least, "y"), ends(F.greatest, "x"), ends(F.greatest, "y"), pad)


def touching(left: DataFrame, right: DataFrame) -> DataFrame:
    """(l, r): rows of both sides, as structs, whose boxes (column box) touch in one scene.

    An item's level is that of the power of two above its size, so it lies in four cells of it at most. Items of one side meet
    those of the other on the level of the larger one; a pair comes from the cell that holds the lower corner of what they share.
    """
    level = F.ceil(F.log2(F.greatest(F.col("box.x1") - F.col("box.x0"), F.col("box.y1") - F.col("box.y0"), F.lit(1e-3)))).cast("int")
    a, b = (_merged(df.select("scene", F.struct(*[c for c in df.columns if c not in ("scene", "box")]).alias("row"), "box", level.alias("level"))) for df in (left, right))
    used = sorted(r.level for r in a.select("level").union(b.select("level")).distinct().collect())  # powers of two between the sizes: a few dozen
    if not used:
        return a.select("scene", F.col("row").alias("l")).join(b.select("scene", F.col("row").alias("r")), "scene")
    levels = F.array(*map(F.lit, used))
    cell = lambda v, k: F.floor(v / F.pow(F.lit(2.0), k))

    def cells(df: DataFrame, side: str, above: bool, strictly: bool) -> DataFrame:
        wanted = F.filter(levels, lambda k: (k > F.col("level")) if strictly else (k >= F.col("level"))) if above else F.array("level")
        out = df.select("scene", F.col("row").alias(side), F.col("box").alias(f"{side}_box"), F.explode(wanted).alias("at"))
        span = lambda c: F.sequence(cell(F.col(f"{side}_box.{c}0"), F.col("at")), cell(F.col(f"{side}_box.{c}1"), F.col("at")))
        return out.withColumn("cx", F.explode(span("x"))).withColumn("cy", F.explode(span("y")))

    def met(x: DataFrame, y: DataFrame) -> DataFrame:
        both = x.join(y, ["scene", "at", "cx", "cy"])
        low = lambda c: F.greatest(F.col(f"l_box.{c}0"), F.col(f"r_box.{c}0"))
        touch = reduce(lambda p, q: p & q, (low(c) <= F.least(F.col(f"l_box.{c}1"), F.col(f"r_box.{c}1")) for c in "xy"))
        return both.where(touch & (cell(low("x"), F.col("at")) == F.col("cx")) & (cell(low("y"), F.col("at")) == F.col("cy"))).select("scene", "l", "r")

    return met(cells(a, "l", False, False), cells(b, "r", True, False)).unionByName(met(cells(a, "l", True, True), cells(b, "r", False, False)))


def _interleave(at: Column, a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    """Whether two ways through a point cross there: one ray of the second lies strictly between those of the first."""
    turn = 2 * math.pi
    angle = lambda p: F.atan2(p["y"] - at["y"], p["x"] - at["x"])
    ccw = lambda x, y: F.pmod(y - x, F.lit(turn))
    span, one, two = ccw(angle(a1), angle(a2)), ccw(angle(a1), angle(b1)), ccw(angle(a1), angle(b2))
    clear = lambda o: (o >= 1e-9) & (F.abs(o - span) >= 1e-9) & (o <= turn - 1e-9)
    return clear(one) & clear(two) & ((one < span) != (two < span))


def _along(s: Column, p: Column) -> Column:
    dx, dy = s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"]
    return ((p["x"] - s["a"]["x"]) * dx + (p["y"] - s["a"]["y"]) * dy) / s["len"]


def _place(s: Column, along: Column) -> Column:
    return F.when((along < -EPS) | (along > s["len"] + EPS), "outside").when(along <= EPS, "start").when(along >= s["len"] - EPS, "end").otherwise("inside")


def _to_segment(p: Column, a: Column, b: Column) -> Column:
    """Distance of a point from a segment."""
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    square = dx * dx + dy * dy
    t = F.when(square == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((p["x"] - a["x"]) * dx + (p["y"] - a["y"]) * dy) / square)))
    return F.hypot(p["x"] - (a["x"] + t * dx), p["y"] - (a["y"] + t * dy))


_OUT = ("scene", "kind", "visible", "exemption", "edges", "nodes", "labels", "length", "distance", "points")


def _pair_findings(pairs: DataFrame, px, radius: float, collinear: float) -> DataFrame:
    """Crossings and shared corridors of legs (l, r) of different routes."""
    l, r = F.col("l"), F.col("r")  # noqa: E741
    rx, ry, qx, qy = l["b"]["x"] - l["a"]["x"], l["b"]["y"] - l["a"]["y"], r["b"]["x"] - r["a"]["x"], r["b"]["y"] - r["a"]["y"]
    gx, gy = r["a"]["x"] - l["a"]["x"], r["a"]["y"] - l["a"]["y"]
    p = pairs.withColumn("det", _cross(rx, ry, qx, qy)).withColumn("parallel", F.abs(F.col("det")) <= 1e-9 * l["len"] * r["len"])
    shared_nodes = F.array_intersect(F.transform(l["ports"], lambda x: x["node"]), F.transform(r["ports"], lambda x: x["node"]))
    p = p.withColumn("hubs", F.filter(F.concat(l["ports"], r["ports"]), lambda x: F.array_contains(shared_nodes, x["node"])))
    near = lambda where: F.exists("hubs", lambda h: F.exists(where, lambda w: _gap(w, h["p"]) <= radius + EPS))
    exempt = lambda where: F.when(l["bundle"] == r["bundle"], "bundle").when(near(where), "shared-endpoint")
    edges = F.array(l["edge"], r["edge"])
    no = F.array().cast("array<string>")
    row = lambda df, kind, exemption, length, distance, points: df.select("scene", F.lit(kind).alias("kind"), (px(length) >= HIDDEN).alias("visible"), exemption.alias("exemption"), edges.alias("edges"), no.alias("nodes"), no.alias("labels"), px(length).alias("length"), distance.cast("double").alias("distance"), points.alias("points"))
    slanted = p.where("NOT parallel")
    u, v = _cross(gx, gy, qx, qy) / F.col("det"), _cross(gx, gy, rx, ry) / F.col("det")
    slanted = slanted.withColumns({"u": u, "pl": _place(l, u * l["len"]), "pr": _place(r, v * r["len"])})
    met = _point(l["a"]["x"] + F.col("u") * rx, l["a"]["y"] + F.col("u") * ry)
    through = slanted.where("pl = 'inside' AND pr = 'inside'").withColumn("at", met)
    at = F.when(F.col("pl") == "start", l["a"]).when(F.col("pr") == "start", r["a"]).otherwise(met)
    touched = slanted.where("NOT (pl = 'inside' AND pr = 'inside')").select("scene", "l", "r", "hubs", "pl", "pr", at.alias("at"))
    along = p.where("parallel")
    on = lambda s, t: ~s["first"] & (_to_segment(s["a"], t["a"], t["b"]) <= EPS)
    first = along.where(on(l, r)).select("scene", "l", "r", "hubs", F.lit("start").alias("pl"), _place(r, _along(r, l["a"])).alias("pr"), l["a"].alias("at"))
    second = along.where(on(r, l)).select("scene", "l", "r", "hubs", _place(l, _along(l, r["a"])).alias("pl"), F.lit("start").alias("pr"), r["a"].alias("at"))
    contact = touched.unionByName(first).unionByName(second).where("pl NOT IN ('outside', 'end') AND pr NOT IN ('outside', 'end') AND NOT (pl = 'start' AND l.first) AND NOT (pr = 'start' AND r.first)")
    # A vertex meets two legs of the other route, and two vertices four pairs: each contact counts once.
    order = Window.partitionBy("scene", "l.edge", "r.edge", "l.i", "r.i", "pl", "pr").orderBy("at.x", "at.y")
    contact = contact.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")
    behind = lambda s, place: F.when(F.col(place) == "start", s["prev"]).otherwise(s["a"])
    contact = contact.where(_interleave(F.col("at"), behind(l, "pl"), l["b"], behind(r, "pr"), r["b"]))
    crossing = through.select("scene", "l", "r", "hubs", "at").unionByName(contact.select("scene", "l", "r", "hubs", "at"))
    crossings = row(crossing, "edge-crossing", exempt(F.array("at")), F.least(l["len"], r["len"]), F.lit(None), F.array("at"))
    apart = F.abs(_cross(rx, ry, gx, gy)) / l["len"]
    a0, a1 = _along(l, r["a"]), _along(l, r["b"])
    lane = along.withColumns({"apart": apart, "lo": F.greatest(F.lit(0.0), F.least(a0, a1)), "hi": F.least(l["len"], F.greatest(a0, a1))}).where((F.col("apart") <= collinear + EPS) & (F.col("hi") - F.col("lo") > EPS))
    on_l = lambda d: _point(l["a"]["x"] + rx / l["len"] * d, l["a"]["y"] + ry / l["len"] * d)
    ends = F.array(on_l(F.col("lo")), on_l(F.col("hi")))
    corridors = row(lane, "shared-corridor", exempt(ends), F.col("hi") - F.col("lo"), px(F.col("apart")), F.array_sort(ends))
    return crossings.unionByName(corridors)


def geometry_findings(nodes: DataFrame, edges: DataFrame, labels: DataFrame, zoom: float = 1.0) -> DataFrame:
    """(scene, kind, visible, exemption, edges, nodes, labels, length, distance, points): findings of seven kinds.

    ``length`` and ``distance`` are in pixels; what is under two pixels is not visible. An exemption tells why a finding is
    none: routes of one bundle, routes near a port that they share, ends in one point, a border of the route's own node, or
    one around it. Ids are unique within a scene.
    """
    world = lambda v: v / zoom
    px = lambda c: F.round(c * zoom, 3)
    pad = world(max(COLLINEAR, LABEL_GAP, BORDER_GAP)) / 2 + EPS
    no = F.array().cast("array<string>")
    nodes, edges, labels = (df.hint("merge") for df in (nodes, edges, labels))
    routes = _merged(_routes(nodes, edges))
    legs = _merged(_segments(routes))
    boxes = _segment_boxes(legs.where(F.col("len") > EPS), pad)
    pairs = touching(boxes, boxes).where("l.edge < r.edge")
    out = [_pair_findings(shared(pairs), px, world(PORT_RADIUS), world(COLLINEAR))]
    tree = nodes.select(F.to_json(F.struct("scene", "id")).alias("id"), F.when(F.col("parent_id").isNotNull(), F.to_json(F.struct("scene", F.col("parent_id").alias("id")))).alias("parent_id"))
    up = closure(tree).where("depth > 0").select(F.from_json("id", "scene string, id string").alias("x"), F.from_json("ancestor_id", "scene string, id string").alias("y"))
    above = _merged(up.select(F.col("x.scene").alias("u_scene"), F.col("x.id").alias("inner"), F.col("y.id").alias("outer")).distinct())

    # Runs along the borders of nodes.
    x0, y0, x1, y1 = F.col("x"), F.col("y"), F.col("x") + F.col("width"), F.col("y") + F.col("height")
    side = lambda way, at, lo, hi: F.struct(F.lit(way).alias("way"), at.alias("at"), lo.alias("lo"), hi.alias("hi"))
    borders = nodes.select("scene", F.col("id").alias("node"), x0.alias("nx0"), y0.alias("ny0"), x1.alias("nx1"), y1.alias("ny1"), F.explode(F.array(side("h", y0, x0, x1), side("h", y1, x0, x1), side("v", x0, y0, y1), side("v", x1, y0, y1))).alias("b"))
    flat = F.col("b.way") == "h"
    borders = _boxed(borders, F.when(flat, F.col("b.lo")).otherwise(F.col("b.at")), F.when(flat, F.col("b.at")).otherwise(F.col("b.lo")), F.when(flat, F.col("b.hi")).otherwise(F.col("b.at")), F.when(flat, F.col("b.at")).otherwise(F.col("b.hi")), pad)
    l, r = F.col("l"), F.col("r")  # noqa: E741
    run = touching(_segment_boxes(legs.where("axis IS NOT NULL").where(F.col("len") > EPS), pad), borders).where("l.axis = r.b.way")
    on = lambda p: F.when(F.col("r.b.way") == "h", p["x"]).otherwise(p["y"])
    off = F.abs(F.when(F.col("r.b.way") == "h", l["a"]["y"]).otherwise(l["a"]["x"]) - F.col("r.b.at"))
    run = run.withColumns({"off": off, "lo": F.greatest(F.col("r.b.lo"), F.least(on(l["a"]), on(l["b"]))), "hi": F.least(F.col("r.b.hi"), F.greatest(on(l["a"]), on(l["b"])))})
    run = run.where((F.col("off") <= world(BORDER_GAP) + EPS) & (px(F.col("hi") - F.col("lo")) >= BORDER_RUN))
    start = F.when(l["first"], l["from_id"]).when(l["last"], l["to_id"])
    end = F.when(l["first"] & l["last"], l["to_id"])
    run = run.withColumns({"c1": start, "c2": end, "own": F.coalesce(start == r["node"], F.lit(False)) | F.coalesce(end == r["node"], F.lit(False))})
    inside = lambda c, name: above.select(F.col("u_scene").alias(f"s_{name}"), F.col("inner").alias(name), F.col("outer").alias(f"o_{name}"))
    for c in ("c1", "c2"):
        a = inside(c, f"in_{c}")
        run = run.join(a, (F.col("scene").cast("string") == F.col(f"s_in_{c}")) & (F.col(c) == F.col(f"in_{c}")) & (F.col("r.node") == F.col(f"o_in_{c}")), "left").drop(f"s_in_{c}", f"o_in_{c}")
    run = run.withColumn("card", F.coalesce("in_c1", "in_c2"))
    card = nodes.select(F.col("scene").alias("d_scene"), F.col("id").alias("d_id"), F.struct("x", "y", "width", "height").alias("d"))
    run = run.join(card, (F.col("scene") == F.col("d_scene")) & (F.col("card") == F.col("d_id")), "left")
    c0 = F.when(F.col("r.b.way") == "h", F.col("d.x")).otherwise(F.col("d.y"))
    c1 = c0 + F.when(F.col("r.b.way") == "h", F.col("d.width")).otherwise(F.col("d.height"))
    part = lambda lo, hi, why: F.struct(lo.alias("lo"), hi.alias("hi"), F.lit(why).cast("string").alias("why"))
    lo, hi = F.col("lo"), F.col("hi")
    parts = F.when(F.col("own"), F.array(part(lo, hi, "own-endpoint"))).when(F.col("card").isNull(), F.array(part(lo, hi, None))).otherwise(F.array(part(lo, F.least(hi, c0), None), part(F.greatest(lo, c0), F.least(hi, c1), "containment"), part(F.greatest(lo, c1), hi, None)))
    run = run.select("scene", "l", "r", "off", F.explode(parts).alias("p")).where((F.col("p.hi") - F.col("p.lo") > EPS) & (F.col("p.why").isNotNull() | (px(F.col("p.hi") - F.col("p.lo")) >= BORDER_RUN)))
    spot = lambda v: F.when(F.col("r.b.way") == "h", _point(v, l["a"]["y"])).otherwise(_point(l["a"]["x"], v))
    length = px(F.col("p.hi") - F.col("p.lo"))
    out.append(run.select("scene", F.lit("container-border-run").alias("kind"), (length >= HIDDEN).alias("visible"), F.col("p.why").alias("exemption"), F.array(l["edge"]).alias("edges"), F.array(r["node"]).alias("nodes"), no.alias("labels"), length.alias("length"), px(F.col("off")).alias("distance"), F.array(spot(F.col("p.lo")), spot(F.col("p.hi"))).alias("points")))

    # Labels too close to other routes and to nodes.
    owner = routes.select(F.col("scene").alias("w_scene"), F.col("edge").alias("edge_id"), F.col("bundle").alias("w_bundle"), "from_id", "to_id")
    own = labels.join(owner.withColumnRenamed("w_scene", "scene"), ["scene", "edge_id"]).withColumnRenamed("id", "label")
    boxed = _boxed(own, x0, y0, x1, y1, pad)
    visible = lambda c: px(F.least(c["width"], c["height"])) >= HIDDEN
    hit = touching(boxed, _segment_boxes(legs, pad)).where("l.edge_id <> r.edge")
    rect = lambda c: (c["x"], c["y"], c["x"] + c["width"], c["y"] + c["height"])
    bx0, by0, bx1, by1 = rect(l)
    outside = lambda p: F.hypot(F.greatest(bx0 - p["x"], F.lit(0.0), p["x"] - bx1), F.greatest(by0 - p["y"], F.lit(0.0), p["y"] - by1))
    corners = [_point(x, y) for x in (bx0, bx1) for y in (by0, by1)]
    dx, dy = r["b"]["x"] - r["a"]["x"], r["b"]["y"] - r["a"]["y"]
    clips = [(-dx, r["a"]["x"] - bx0), (dx, bx1 - r["a"]["x"]), (-dy, r["a"]["y"] - by0), (dy, by1 - r["a"]["y"])]
    enter = F.greatest(F.lit(0.0), *(F.when(p < 0, q / p).otherwise(0.0) for p, q in clips))
    leave = F.least(F.lit(1.0), *(F.when(p > 0, q / p).otherwise(1.0) for p, q in clips))
    misses = reduce(lambda a, b: a | b, ((p == 0) & (q < 0) for p, q in clips))
    distance = F.when(~misses & (enter <= leave), 0.0).otherwise(F.least(outside(r["a"]), outside(r["b"]), *(_to_segment(c, r["a"], r["b"]) for c in corners)))
    hit = hit.withColumn("distance", distance).where(F.col("distance") <= world(LABEL_GAP) + EPS)
    near = hit.groupBy("scene", F.col("l.label").alias("label"), F.col("r.edge").alias("edge")).agg(F.min("distance").alias("distance"), F.first("l").alias("l"), F.first("r.bundle").alias("bundle"))
    out.append(near.select("scene", F.lit("label-clearance").alias("kind"), visible(l).alias("visible"), F.when(F.col("bundle") == l["w_bundle"], "bundle").alias("exemption"), F.array_sort(F.array(l["edge_id"], F.col("edge"))).alias("edges"), no.alias("nodes"), F.array("label").alias("labels"), F.lit(None).cast("double").alias("length"), px(F.col("distance")).alias("distance"), F.lit(None).cast("array<struct<x: double, y: double>>").alias("points")))
    cards = _boxed(nodes.withColumnRenamed("id", "node"), x0, y0, x1, y1, pad)
    over = touching(boxed, cards)
    rx0, ry0, rx1, ry1 = rect(r)
    between = F.hypot(F.greatest(rx0 - bx1, F.lit(0.0), bx0 - rx1), F.greatest(ry0 - by1, F.lit(0.0), by0 - ry1))
    over = over.withColumn("distance", between).where(F.col("distance") <= world(LABEL_GAP) + EPS)
    ends = F.filter(F.array(l["from_id"], l["to_id"]), lambda n: n.isNotNull())
    bounds = nodes.select(F.col("scene").alias("e_scene"), F.col("id").alias("e_id"), F.struct("x", "y", "width", "height").alias("e"))
    each = over.select("scene", F.col("l.label").alias("label"), F.col("r.node").alias("node"), r.alias("r"), F.explode(ends).alias("end"))
    each = each.join(bounds, (F.col("scene") == F.col("e_scene")) & (F.col("end") == F.col("e_id"))).join(above, (F.col("scene").cast("string") == F.col("u_scene")) & (F.col("end") == F.col("inner")) & (F.col("node") == F.col("outer")), "left")
    e = F.col("e")
    holds = F.col("inner").isNotNull() | ((rx0 <= e["x"]) & (ry0 <= e["y"]) & (rx1 >= e["x"] + e["width"]) & (ry1 >= e["y"] + e["height"]))
    both = each.groupBy("scene", "label", "node").agg((F.bool_and(holds) & ~F.bool_or(F.col("end") == F.col("node"))).alias("around"))
    over = over.select("scene", F.col("l.label").alias("label"), F.col("r.node").alias("node"), "l", "distance").join(both, ["scene", "label", "node"], "left")
    out.append(over.select("scene", F.lit("label-clearance").alias("kind"), visible(l).alias("visible"), F.when(F.col("around"), "containment").alias("exemption"), F.array(l["edge_id"]).alias("edges"), F.array("node").alias("nodes"), F.array("label").alias("labels"), F.lit(None).cast("double").alias("length"), px(F.col("distance")).alias("distance"), F.lit(None).cast("array<struct<x: double, y: double>>").alias("points")))

    # Ends that crowd at a node.
    ends_at = routes.where(F.size("pts") >= 2).select("scene", "edge", "bundle", F.explode(F.array_distinct("ports")).alias("port")).select("scene", "edge", "bundle", "port.node", "port.p")
    ports = _boxed(ends_at, F.col("p.x"), F.col("p.y"), F.col("p.x"), F.col("p.y"), world(PORT_GAP) / 2 + EPS)
    crowd = touching(ports, ports).where("l.node = r.node AND l.edge < r.edge").withColumn("distance", px(_gap(F.col("l.p"), F.col("r.p")))).where(F.col("distance") < PORT_GAP)
    why = F.when(l["bundle"] == r["bundle"], "bundle").when(_gap(l["p"], r["p"]) <= EPS, "shared-port")
    out.append(crowd.select("scene", F.lit("endpoint-crowding").alias("kind"), (F.col("distance") >= HIDDEN).alias("visible"), why.alias("exemption"), F.array(l["edge"], r["edge"]).alias("edges"), F.array(l["node"]).alias("nodes"), no.alias("labels"), F.lit(None).cast("double").alias("length"), "distance", F.array_sort(F.array(l["p"], r["p"])).alias("points")))

    # Short routes, and short legs of routes that are not.
    total = F.coalesce(F.aggregate(F.transform(F.sequence(F.lit(1), F.greatest(F.size("pts") - 1, F.lit(1))), lambda i: F.coalesce(_gap(F.get("pts", i - 1), F.get("pts", i)), F.lit(0.0))), F.lit(0.0), lambda s, x: s + x), F.lit(0.0))
    held = F.array_sort(F.array_distinct(F.filter(F.array("from_id", "to_id"), lambda n: n.isNotNull())))
    sized = routes.withColumn("total", px(total)).withColumn("held", held)
    short = sized.where(F.col("total") < ROUTE)
    blank = F.lit(None).cast("string").alias("exemption")
    out.append(short.select("scene", F.lit("short-route").alias("kind"), (F.col("total") >= HIDDEN).alias("visible"), blank, F.array("edge").alias("edges"), F.col("held").alias("nodes"), no.alias("labels"), F.col("total").alias("length"), F.lit(None).cast("double").alias("distance"), F.col("pts").alias("points")))
    long = sized.where((F.col("total") >= ROUTE) & (F.size("pts") >= 3)).select("scene", "edge", "held")
    leg = legs.join(long, ["scene", "edge"]).withColumn("length", px(F.col("len"))).where(F.col("length") < LEG)
    out.append(leg.select("scene", F.lit("short-leg").alias("kind"), (F.col("length") >= HIDDEN).alias("visible"), blank, F.array("edge").alias("edges"), F.col("held").alias("nodes"), no.alias("labels"), "length", F.lit(None).cast("double").alias("distance"), F.array_sort(F.array("a", "b")).alias("points")))
    return reduce(lambda a, b: a.unionByName(b), (x.select(*_OUT) for x in out)).distinct()

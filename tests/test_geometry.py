"""Findings of drawings against all pairs on random scenes, and one case of each kind."""

from __future__ import annotations

import math
import random

import pytest

from strataloom.operators import geometry as G

NODE = "scene int, id string, parent_id string, x double, y double, width double, height double"
EDGE = "scene int, id string, from_id string, to_id string, bundle string, points array<struct<x: double, y: double>>"
LABEL = "scene int, id string, edge_id string, x double, y double, width double, height double"
EPS = 1e-6


def _clean(pts):
    out = []
    for p in pts:
        if out and out[-1] == p:
            continue
        if len(out) > 1:
            (ax, ay), (bx, by) = (out[-1][0] - out[-2][0], out[-1][1] - out[-2][1]), (p[0] - out[-1][0], p[1] - out[-1][1])
            if ax * by == ay * bx and ax * bx + ay * by > 0:
                out[-1] = p
                continue
        out.append(p)
    return out


def _seg_dist(p, a, b):
    dx, dy = b[0] - a[0], b[1] - a[1]
    t = max(0, min(1, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / (dx * dx + dy * dy)))
    return math.dist(p, (a[0] + t * dx, a[1] + t * dy))


def _rect_dist(r, q):
    return math.hypot(max(q[0] - r[2], 0, r[0] - q[2]), max(q[1] - r[3], 0, r[1] - q[3]))


def _seg_rect(a, b, r):
    """By walking along the segment: exact where it touches, else from corners and ends."""
    t0, t1 = 0.0, 1.0
    for p, q in ((a[0] - b[0], a[0] - r[0]), (b[0] - a[0], r[2] - a[0]), (a[1] - b[1], a[1] - r[1]), (b[1] - a[1], r[3] - a[1])):
        if p == 0 and q < 0:
            t0 = 2
        elif p < 0:
            t0 = max(t0, q / p)
        elif p > 0:
            t1 = min(t1, q / p)
    if t0 <= t1:
        return 0.0
    return min(_rect_dist((*a, *a), r), _rect_dist((*b, *b), r), *(_seg_dist((x, y), a, b) for x in (r[0], r[2]) for y in (r[1], r[3])))


def _all_pairs(nodes, edges, labels, zoom):
    px, out = lambda v: round(v * zoom, 3), set()
    box = {n[1]: (n[3], n[4], n[3] + n[5], n[4] + n[6]) for n in nodes}
    parent = {n[1]: n[2] for n in nodes}

    def above(i):
        seen = []
        while (i := parent.get(i)) in box and i not in seen:
            seen.append(i)
        return seen

    route = {e[1]: _clean([tuple(p) for p in e[5]]) for e in edges}
    ends = {e[1]: (e[2] if e[2] in box else None, e[3] if e[3] in box else None) for e in edges}
    bundle = {e[1]: e[4] for e in edges}
    ports = {i: [(n, p) for n, p in zip(ends[i], (pts[0], pts[-1])) if n] if pts else [] for i, pts in route.items()}

    def add(kind, size, exemption, es, ns=(), ls=(), length=None, distance=None):
        out.add((kind, size >= 2, exemption, tuple(es), tuple(ns), tuple(ls), length, distance))

    def exempt(a, b, where):
        if bundle[a] and bundle[a] == bundle[b]:
            return "bundle"
        hubs = {n for n, _ in ports[a]} & {n for n, _ in ports[b]}
        return "shared-endpoint" if any(n in hubs and math.dist(p, w) <= 16 / zoom + EPS for n, p in ports[a] + ports[b] for w in where) else None

    legs = {i: list(zip(pts, pts[1:])) for i, pts in route.items()}
    for a in sorted(route):
        for b in sorted(route):
            if a >= b:
                continue
            contacts = set()
            for i, (p, q) in enumerate(legs[a]):
                for j, (s, t) in enumerate(legs[b]):
                    r1, r2 = (q[0] - p[0], q[1] - p[1]), (t[0] - s[0], t[1] - s[1])
                    l1, l2 = math.hypot(*r1), math.hypot(*r2)
                    det, g = r1[0] * r2[1] - r1[1] * r2[0], (s[0] - p[0], s[1] - p[1])
                    tries = []
                    if abs(det) > 1e-9 * l1 * l2:
                        u, v = (g[0] * r2[1] - g[1] * r2[0]) / det, (g[0] * r1[1] - g[1] * r1[0]) / det
                        tries.append((u * l1, v * l2, (p[0] + u * r1[0], p[1] + u * r1[1])))
                    else:
                        if i and _seg_dist(p, s, t) <= EPS:
                            tries.append((0, math.dist(s, p) * (1 if (p[0] - s[0]) * r2[0] + (p[1] - s[1]) * r2[1] >= 0 else -1), p))
                        if j and _seg_dist(s, p, q) <= EPS:
                            tries.append((math.dist(s, p) * (1 if g[0] * r1[0] + g[1] * r1[1] >= 0 else -1), 0, s))
                        apart = abs(r1[0] * g[1] - r1[1] * g[0]) / l1
                        d0, d1 = sorted(((z[0] - p[0]) * r1[0] + (z[1] - p[1]) * r1[1]) / l1 for z in (s, t))
                        lo, hi = max(0, d0), min(l1, d1)
                        if apart <= 2 / zoom + EPS and hi - lo > EPS:
                            at = [(p[0] + r1[0] / l1 * d, p[1] + r1[1] / l1 * d) for d in (lo, hi)]
                            add("shared-corridor", px(hi - lo), exempt(a, b, at), (a, b), length=px(hi - lo), distance=px(apart))
                    for d1, d2, at in tries:
                        if not (-EPS <= d1 < l1 - EPS and -EPS <= d2 < l2 - EPS):
                            continue
                        v1, v2 = d1 <= EPS, d2 <= EPS
                        if v1 and not i or v2 and not j or (i, v1, j, v2) in contacts:
                            continue
                        contacts.add((i, v1, j, v2))
                        rays = [legs[a][i - 1][0] if v1 else p, q, legs[b][j - 1][0] if v2 else s, t]
                        ang = [math.atan2(z[1] - at[1], z[0] - at[0]) for z in rays]
                        span, one, two = ((x - ang[0]) % (2 * math.pi) for x in ang[1:])
                        if all(1e-9 <= o <= 2 * math.pi - 1e-9 and abs(o - span) >= 1e-9 for o in (one, two)) and (one < span) != (two < span):
                            add("edge-crossing", px(min(l1, l2)), exempt(a, b, [at]), (a, b), length=px(min(l1, l2)))
            for n1, p1 in set(ports[a]):
                for n2, p2 in set(ports[b]):
                    if n1 == n2 and len(route[a]) > 1 and len(route[b]) > 1 and px(math.dist(p1, p2)) < 8:
                        d = px(math.dist(p1, p2))
                        why = "bundle" if bundle[a] and bundle[a] == bundle[b] else "shared-port" if math.dist(p1, p2) <= EPS else None
                        add("endpoint-crowding", d, why, (a, b), (n1,), distance=d)
    for e, own in legs.items():
        total = px(sum(math.dist(p, q) for p, q in own))
        held = sorted({n for n in ends[e] if n})
        if total < 16:
            add("short-route", total, None, (e,), held, length=total)
        elif len(own) > 1:
            for p, q in own:
                if px(math.dist(p, q)) < 6:
                    add("short-leg", px(math.dist(p, q)), None, (e,), held, length=px(math.dist(p, q)))
        for i, (p, q) in enumerate(own):
            k = 0 if p[1] == q[1] else 1 if p[0] == q[0] else None
            if k is None:
                continue
            for n, r in box.items():
                for at in (r[1 - k], r[3 - k]):
                    off, lo, hi = abs(p[1 - k] - at), max(r[k], min(p[k], q[k])), min(r[2 + k], max(p[k], q[k]))
                    if off > 3 / zoom + EPS or px(hi - lo) < 48:
                        continue
                    cards = [ends[e][0]] if i == 0 else [ends[e][1]] if i == len(own) - 1 else []
                    cards += [ends[e][1]] if i == 0 and len(own) == 1 else []
                    parts = [(lo, hi, None)]
                    if n in cards:
                        parts = [(lo, hi, "own-endpoint")]
                    elif card := next((c for c in cards if c and n in above(c)), None):
                        c0, c1 = box[card][k], box[card][2 + k]
                        parts = [(lo, min(hi, c0), None), (max(lo, c0), min(hi, c1), "containment"), (max(lo, c1), hi, None)]
                    for x, y, why in parts:
                        if y - x > EPS and (why or px(y - x) >= 48):
                            add("container-border-run", px(y - x), why, (e,), (n,), length=px(y - x), distance=px(off))
    for _, lab, own, x, y, w, h in labels:
        if own not in route:
            continue
        r = (x, y, x + w, y + h)
        for e in route:
            if e != own and legs[e] and (d := min(_seg_rect(p, q, r) for p, q in legs[e])) <= 4 / zoom + EPS:
                add("label-clearance", px(min(w, h)), "bundle" if bundle[e] and bundle[e] == bundle[own] else None, sorted((own, e)), (), (lab,), distance=px(d))
        for n, b in box.items():
            if (d := _rect_dist(r, b)) <= 4 / zoom + EPS:
                mine = [z for z in ends[own] if z]
                around = mine and n not in mine and all(n in above(z) or (b[0] <= box[z][0] and b[1] <= box[z][1] and b[2] >= box[z][2] and b[3] >= box[z][3]) for z in mine)
                add("label-clearance", px(min(w, h)), "containment" if around else None, (own,), (n,), (lab,), distance=px(d))
    return out


def _scene(rnd, k):
    step = rnd.choice([4, 10, 25])
    at = lambda n: float(rnd.randrange(n) * step)
    nodes = [(k, "root", None, 0.0, 0.0, 20.0 * step, 20.0 * step)]
    nodes += [(k, f"n{i}", rnd.choice(["root", f"n{i - 1}" if i else "root", None, "gone"]), at(14), at(14), at(6) + step, at(6) + step) for i in range(5)]
    edges = []
    for i in range(9):
        a, b = rnd.choice(nodes[1:]), rnd.choice(nodes[1:])
        pts = [(a[3], a[4])]
        for _ in range(rnd.randrange(0, 6)):
            x, y = pts[-1]
            pts.append(rnd.choice([(at(20), y), (x, at(20)), (x + 1.0, y), (x, y), (at(20), at(20))]))
        edges.append((k, f"e{i}", a[1] if rnd.random() < 0.9 else "lost", b[1], rnd.choice([None, None, "b1", "b2"]), pts))
    labels = [(k, f"l{i}", rnd.choice(["e0", "e3", "nope"]), at(18), at(18), rnd.choice([1.0, 12.0]), 8.0) for i in range(5)]
    return nodes, edges, labels


@pytest.mark.parametrize("zoom", [1.0, 0.5])
def test_findings_equal_all_pairs(spark, zoom):
    rnd = random.Random(int(zoom * 10))
    scenes = [_scene(rnd, k) for k in range(25)]
    frames = [spark.createDataFrame([row for s in scenes for row in s[i]], schema) for i, schema in enumerate((NODE, EDGE, LABEL))]
    got = G.geometry_findings(*frames, zoom=zoom).collect()
    seen = set()
    for k, scene in enumerate(scenes):
        ours = {(r.kind, r.visible, r.exemption, tuple(r.edges), tuple(r.nodes), tuple(r.labels), r.length, r.distance) for r in got if r.scene == k}
        want = _all_pairs(*scene, zoom)
        assert ours == want, (k, sorted(ours - want, key=str)[:3], sorted(want - ours, key=str)[:3])
        seen |= {x[0] for x in want} | {x[2] for x in want}
    assert {"edge-crossing", "shared-corridor", "label-clearance", "container-border-run", "endpoint-crowding", "short-route", "short-leg"} <= seen
    assert {"bundle", "shared-endpoint", "shared-port", "containment", "own-endpoint"} <= seen


def test_empty_scene(spark):
    frames = [spark.createDataFrame([], s) for s in (NODE, EDGE, LABEL)]
    assert G.geometry_findings(*frames).count() == 0

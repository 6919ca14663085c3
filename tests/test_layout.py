"""Layout, excerpts and code patterns against plain computations."""

from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from strataloom.functions import parsers
from strataloom.functions import text as X
from strataloom.operators import layout as L
from strataloom.operators import spatial as P
from strataloom.operators import validate as V


def _columns(n, w, h, target, gap, px, py, cap=2.2):
    if n <= 1:
        return n
    rows = lambda c: math.ceil(n / c)
    aspect = lambda c: (c * w + gap * (c - 1) + px) / (rows(c) * h + gap * (rows(c) - 1) + py)
    off = lambda c: abs(math.log(aspect(c)) - math.log(target))
    seed = min(n, max(1, math.floor(math.sqrt(target * n * h / w) + 0.5)))
    best = min((c for c in (seed - 1, seed, seed + 1) if 1 <= c <= n), key=lambda c: (off(c), c))
    if 1 / cap <= aspect(best) <= cap:
        return best
    return min((c for c in range(1, n + 1) if 1 / cap <= aspect(c) <= cap), key=lambda c: (off(c), c), default=best)


def test_columns_reach_the_wanted_shape(spark):
    rnd = random.Random(3)
    rows = [(n, rnd.choice([10.0, 40.0, 300.0]), rnd.choice([8.0, 30.0, 200.0])) for n in list(range(0, 30)) + [57, 200, 1001]]
    df = spark.createDataFrame(rows, "n int, w double, h double")
    for target in (0.6, 1.6):
        got = df.select("*", L.columns_for_aspect(F.col("n"), F.col("w"), F.col("h"), target, 4.0, 16.0, 12.0).alias("c")).collect()
        assert [r.c for r in got] == [_columns(r.n, r.w, r.h, target, 4.0, 16.0, 12.0) for r in got]


def _layout(tree, leaf, pad, gap):
    kids = {}
    for i, p in tree.items():
        kids.setdefault(p if p in tree else None, []).append(i)
    size, out = {}, {}

    def cells(i):
        own = sorted(kids[i])
        c = min(3, math.ceil(math.sqrt(len(own))))
        ws = [max(size[k][0] for k in own[j::c]) for j in range(c)]
        hs = [max(size[k][1] for k in own[j : j + c]) for j in range(0, len(own), c)]
        return own, c, ws, hs

    def measure(i):
        for k in kids.get(i, []):
            measure(k)
        if i in kids:
            _, _, ws, hs = cells(i)
            size[i] = (sum(ws) + gap * (len(ws) - 1) + 2 * pad, sum(hs) + gap * (len(hs) - 1) + 2 * pad)
        else:
            size[i] = leaf

    def place(i, x, y):
        out[i] = (x, y, *size[i])
        if i in kids:
            own, c, ws, hs = cells(i)
            for n, k in enumerate(own):
                col, row = n % c, n // c
                place(k, x + pad + sum(ws[:col]) + gap * col + (ws[col] - size[k][0]) / 2, y + pad + sum(hs[:row]) + gap * row + (hs[row] - size[k][1]) / 2)

    at = 0
    for root in sorted(kids[None]):
        measure(root)
        place(root, at, 0)
        at += size[root][0] + 100
    return out


def test_containment_equals_a_walk(spark):
    rnd = random.Random(8)
    tree = {"r1": None, "r2": "gone"}
    for k in range(120):
        tree[f"e{k:03}"] = rnd.choice(list(tree))
    df = spark.createDataFrame(list(tree.items()) + [("x", "y"), ("y", "x")], "id string, parent_id string").repartition(5)
    got = {r.id: (r.x, r.y, r.width, r.height) for r in L.containment_layout(df, (30, 20), 8, 4).collect()}
    want = _layout(tree, (30.0, 20.0), 8, 4)
    assert got.keys() == want.keys() and all(abs(a - b) < 1e-6 for k in got for a, b in zip(got[k], want[k]))
    assert L.containment_layout(df.limit(0), (1, 1), 1, 1).count() == 0


def _clamp(text, start, end, focus):
    lines = text.replace("\r\n", "\n").split("\n")
    if not 1 <= start <= len(lines) or end < start:
        return None
    last = min(len(lines), end)
    if focus is not None and not start <= focus <= last:
        return None
    at = start if focus is None else max(start, focus - 8)
    out, chars, first = [], 0, at
    for n in range(at, last + 1):
        line = lines[n - 1]
        if len(line) > 512:
            if out:
                break
            first = n + 1
            continue
        grown = chars + len(line) + (1 if out else 0)
        if grown > 4096:
            break
        out.append(line)
        chars = grown
        if len(out) == 48:
            break
    return (first, out) if out else None


def test_excerpts_are_clamped(spark):
    rnd = random.Random(5)
    rows = []
    for i in range(120):
        t = rnd.choice(["\n", "\r\n"]).join("x" * rnd.choice([0, 3, 80, 300, 511, 512, 513, 900]) for _ in range(rnd.randrange(1, 90)))
        rows.append((i, t, rnd.randrange(0, 60), rnd.randrange(0, 90), rnd.choice([None, rnd.randrange(0, 60)])))
    df = spark.createDataFrame(rows, "i int, t string, a int, b int, f int")
    got = {r.i: r.x and (r.x.start_line, r.x.lines) for r in df.select("i", X.clamp_excerpt(F.col("t"), F.col("a"), F.col("b"), F.col("f")).alias("x")).where("f IS NOT NULL OR x IS NOT NULL OR true").collect()}
    for i, t, a, b, f in rows:
        if f is None:
            one = df.where(F.col("i") == i).select(X.clamp_excerpt(F.col("t"), F.col("a"), F.col("b")).alias("x")).first().x if i % 20 == 0 else None
            assert one is None or (one.start_line, one.lines) == _clamp(t, a, b, None)
        else:
            assert got[i] == _clamp(t, a, b, f), i


def test_code_without_comments_and_strings(spark):
    t = 'a = "// no"; // yes\nb = \'/* no */\' /* if (x)\n for */ if (c && d) {} `t // ${x}`'
    r = spark.createDataFrame([(t,)], "t string").select(X.without_comments(F.col("t")).alias("c"), X.code_only(F.col("t")).alias("o"), X.branch_count(F.col("t")).alias("n")).first()
    assert r.c == 'a = "// no"; \nb = \'/* no */\'  if (c && d) {} `t // ${x}`' and r.o == 'a = ""; \nb = ""  if (c && d) {} ""' and r.n == 3


def test_names_paths_and_leaves(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first().v
    assert one(X.types_target(F.lit("@types/a__b"))) == "@a/b" and one(X.types_target(F.lit("@types/node"))) == "node" and one(X.types_target(F.lit("node"))) is None
    paths = one(X.test_paths(F.lit("src/a.b.ts")))
    assert paths[0] == "src/a.b.test.ts" and paths[16] == "src/__tests__/a.b.test.ts" and len(paths) == 32
    assert one(X.test_paths(F.lit("a.rs"))) is None and one(X.test_paths(F.lit("x.mjs")))[2] == "x.spec.ts"
    assert parsers.string_leaves('{"a": ["x", {"b": "y"}, 3, null], "c": "z"}') == ["x", "y", "z"]


def test_hits_and_rects(spark):
    rows = [(1, 0.0, 0.0, 10.0, 10.0, 1), (2, 0.0, 0.0, 10.0, 10.0, 1), (3, 14.0, 14.0, 5.0, 5.0, 9), (4, 100.0, 0.0, 5.0, 5.0, 99)]
    df = spark.createDataFrame(rows, "id int, x double, y double, w double, h double, z int")
    assert P.hit_test(df, 10.5, 10.5, 4.0).first().id == 2  # 3 lies within the box, but not within the distance
    assert P.hit_test(df, 12.0, 12.0, 4.0).first().id == 3 and P.hit_test(df, 50.0, 50.0, 4.0).isEmpty()


def test_extraction_finds_rings(spark):
    e = spark.createDataFrame([("component:a", "component", "component:b", "a", None), ("component:b", "component", "component:a", "b", "r" * 2001)], "id string, kind string, parent_id string, name string, responsibility string")
    r = spark.createDataFrame([("relation:x", "component:a", "component:a", "calls", None, "t" * 121, 1)], "id string, from_id string, to_id string, kind string, label string, technology string, evidence long")
    got = {(x.path, x.message) for x in V.extraction(e, r).collect()}
    assert got == {(f"entities/component:{i}", m) for i in "ab" for m in ("wrong kind of parent", "containment cycle")} | {("entities/component:b", "responsibility is too long"), ("relations/relation:x", "technology is too long")}

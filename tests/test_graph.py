from __future__ import annotations

import random
from collections import deque

from pyspark.sql import functions as F

from strataloom.operators import graph as G
from strataloom.operators import validate as V

E = "id string, kind string, rank int, parent_id string, name string"
R = "id string, from_id string, to_id string, kind string, label string, technology string, optional boolean"


def test_closure_ends_on_a_cycle(spark):
    e = spark.createDataFrame([("a", "code", 3, "b", "a"), ("b", "code", 3, "a", "b"), ("c", "code", 3, None, "c"), ("d", "code", 3, "lost", "d")], E)
    got = {(r.id, r.ancestor_id, r.depth) for r in G.closure(e).collect()}
    assert got == {("a", "a", 0), ("a", "b", 1), ("b", "b", 0), ("b", "a", 1), ("c", "c", 0), ("d", "d", 0)}


def test_canonical_paths_match_breadth_first_search(spark):
    rnd = random.Random(7)
    nodes = [f"n{i:02d}" for i in range(24)]
    edges = sorted({(rnd.choice(nodes), rnd.choice(nodes)) for _ in range(60)} | {("n00", "n00"), ("n01", "n01")})
    want = {}
    for s in ("n00", "n05"):
        best = {s: [s]}
        queue = deque([s])
        while queue:
            at = queue.popleft()
            for b in sorted(b for a, b in edges if a == at):
                if b not in best:
                    best[b] = [*best[at], b]
                    queue.append(b)
        want |= {(s, n): p for n, p in best.items()}
    df = spark.createDataFrame(edges, "from_id string, to_id string").repartition(5)
    starts = spark.createDataFrame([("n00",), ("n05",)], "source string")
    got = {(r.source, r.node): r.path for r in G.shortest_paths(df, starts).collect()}
    assert got == want


def test_path_status(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "from_id string, to_id string")
    known = spark.createDataFrame([(x,) for x in "abcdz"], "id string")
    run = lambda *a, **k: G.path_status(edges, *a, known=known, **k).first()
    assert run("a", "c", 5).path == ["a", "b", "c"]
    assert (run("a", "d", 2).status, run("a", "d", 2).reason) == ("unavailable", "hopLimit")
    assert run("a", "z", 5).status == "unreachable"
    assert run("a", "z", 5, partial=True).reason == "partialGraph"
    assert run("q", "a", 5).reason == "unknownFromEntity"
    assert run("a", "q", 5).reason == "unknownToEntity"
    assert run("a", "a", 5).path == ["a"]
    assert run("", "a", 5).reason == "invalidQuery"


def test_lift_rules(spark):
    e = spark.createDataFrame(
        [("s", "softwareSystem", 0, None, "s"), ("x", "container", 1, "s", "x"), ("y", "container", 1, "s", "y"), ("x1", "code", 3, "x", "x1"), ("y1", "code", 3, "y", "y1"), ("y2", "code", 3, "y", "y2")], E
    )
    r = spark.createDataFrame(
        [
            ("r1", "x1", "y1", "uses", "reads", "http", True),
            ("r2", "x1", "y2", "uses", " reads ", "http", False),
            ("r3", "x", "y", "uses", None, None, False),
            ("r4", "y1", "y2", "uses", None, None, False),
            ("r5", "x1", "y1", "duplicates", None, None, False),
            ("r6", "x1", "gone", "uses", None, None, False),
        ],
        R,
    )
    top = {(v.rep_from, v.rep_to, v.kind): v for v in G.visual_edges(r, e, 1).collect()}
    assert set(top) == {("x", "y", "uses")}
    assert (top["x", "y", "uses"]["count"], top["x", "y", "uses"].label, top["x", "y", "uses"].optional_count) == (3, "3 uses", 1)
    code = {(v.rep_from, v.rep_to, v.kind) for v in G.visual_edges(r, e, 3).collect()}
    assert code == {("x1", "y1", "uses"), ("x1", "y2", "uses"), ("y1", "y2", "uses"), ("x1", "y1", "duplicates")}


def test_shuffled_input_gives_the_same_edges(spark, rows):
    e = spark.createDataFrame([("s", "softwareSystem", 0, None, "s")] + [(f"c{i}", "container", 1, "s", "c") for i in range(4)] + [(f"k{i}", "code", 3, f"c{i % 4}", "k") for i in range(40)], E)
    rel = [(f"r{i}", f"k{i % 40}", f"k{(i * 7 + 1) % 40}", "uses", f"l{i % 2}", None, False) for i in range(120)]
    first = rows(G.visual_edges(spark.createDataFrame(rel, R), e, 1))
    random.Random(3).shuffle(rel)
    assert rows(G.visual_edges(spark.createDataFrame(rel, R).repartition(7), e.repartition(3), 1)) == first


def test_forest_promotes_cycles(spark):
    e = spark.createDataFrame([("a", "code", 3, "b", ""), ("b", "code", 3, "a", ""), ("c", "code", 3, "b", ""), ("d", "code", 3, "gone", ""), ("A", "code", 3, "c", "")], E)
    got = {r.id: (r.root, r.level) for r in G.forest(e).collect()}
    assert got == {"a": ("a", 0), "b": ("a", 1), "c": ("a", 2), "d": ("d", 0), "A": ("a", 3)}


def test_trees_and_rings_of_any_depth(spark):
    """A chain of twelve below a root, a ring of nine with a tail, a loop of one, an unknown parent."""
    rows = [(f"n{i}", "code", 3, f"n{i - 1}" if i else None, "") for i in range(12)] + [(f"r{i}", "code", 3, f"r{(i + 1) % 9}", "") for i in range(9)]
    rows += [("t", "code", 3, "r4", ""), ("o", "code", 3, "o", ""), ("u", "code", 3, "gone", "")]
    e = spark.createDataFrame(rows, E).repartition(3)
    up = {}
    for r in G.closure(e).collect():
        up.setdefault(r.id, {})[r.ancestor_id] = r.depth
    assert up["n11"] == {f"n{11 - d}": d for d in range(12)} and up["u"] == {"u": 0} and up["o"] == {"o": 0}
    assert up["r2"] == {f"r{(2 + d) % 9}": d for d in range(9)} and up["t"] == {"t": 0} | {f"r{(4 + d) % 9}": d + 1 for d in range(9)}
    f = {r.id: (r.root, r.level) for r in G.forest(e).collect()}
    assert f["n11"] == ("n0", 11) and f["t"] == ("r0", 6) and f["r0"] == ("r0", 0) and f["u"] == ("u", 0)
    assert {(r.id, r.descendants) for r in G.subtree_counts(e).collect()} >= {("n0", 11), ("r4", 9), ("u", 0)}
    assert {r.path for r in V.acyclic(e).collect()} == {f"entities/r{i}" for i in range(9)} | {"entities/t", "entities/o"}


def test_alias_chains(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "c"), ("x", "z"), ("p", "q"), ("q", "p")], "name string, target string")
    got = {r.name: (r.target, r.ambiguous) for r in G.alias_fixpoint(links).collect()}
    assert got == {"a": ("c", False), "b": ("c", False), "x": ("c", True)}


def test_snapshot_rules_pass_on_good_input(spark):
    e = spark.createDataFrame([("s", "softwareSystem", 0, None, "s"), ("x", "code", 3, "s", "x")], E)
    r = spark.createDataFrame([("r1", "x", "x", "duplicates", None, None, False)], R)
    assert V.snapshot(e, r).count() == 0
    bad = V.increasing(spark.createDataFrame([("p", 1, 1), ("p", 2, 1)], "k string, n int, rev int"), "t", ["k"], "rev", "n")
    assert bad.count() == 1


def test_degrees_count_a_self_relation_once(spark):
    r = spark.createDataFrame([("a", "a"), ("a", "b")], "from_id string, to_id string")
    assert {x.id: x.degree for x in G.degrees(r).collect()} == {"a": 2, "b": 1}
    n = spark.createDataFrame([("a",)], "node string")
    inc = G.incident(r.withColumns({"id": F.lit("i"), "kind": F.lit("uses")}), n)
    assert inc.count() == 2

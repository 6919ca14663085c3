"""Units of files against a plain reading of the rules, timelines against sampling by hand, long chains."""

from __future__ import annotations

import math
import random
import re

import pytest

from strataloom.operators import discovery as D
from strataloom.operators.graph import shortest_paths
from strataloom.operators.playback import sample_timelines
from strataloom.operators.ranking import blob_chunks


def _plain(files, all_members=False):
    """{path: (unit, kind, reason)} of one repository by loops over all roots."""
    paths = [p for p, _ in files]
    text = dict(files)
    globs, inside = [], False
    for line in (text.get("pnpm-workspace.yaml") or "").split("\n"):
        line = re.sub("#.*$", "", line)
        if re.match(r"packages:\s*$", line):
            inside = True
        elif inside and (m := re.match(r"\s*-\s*['\"]?([^'\"\s]+)['\"]?\s*$", line)):
            globs.append(m[1])
        elif inside and re.match(r"\S", line):
            break
    rx = ["/".join("[^/]+(?:/[^/]+)*" if s == "**" else re.escape(s).replace(r"\*", "[^/]*") for s in g.split("/")) for g in globs]
    members = [p[: -len("/package.json")] for p in paths if p.endswith("/package.json") and any(re.fullmatch(r, p[: -len("/package.json")]) for r in rx)]
    crates = [p[: -len("/Cargo.toml")] for p in paths if re.fullmatch(r"crates/[^/]+/Cargo\.toml", p)]
    test = lambda p: bool(re.search(r"(^|/)testdata/", p))
    out = lambda p: bool(re.search(r"\.d\.ts$|(^|/)dist/|\.(test|spec|bench)\.[cm]?[jt]sx?$|(^|/)__(tests|mocks)__/|_qa\.rs$", p) or p.endswith(".rs") and re.search("(^|/)(tests|benches|examples)/", p))
    scripts = "tsconfig.json" not in paths and not any(re.search(r"\.(ts|tsx|mts|cts)$", p) and not test(p) and not out(p) for p in paths)
    best = lambda p, roots: max((r for r in roots if p.startswith(r + "/")), key=len, default=None)
    got = {}
    for p in paths:
        member, crate = best(p, members), best(p, crates)
        if not (re.search(r"\.([mc]?ts|tsx|[mc]js|jsx|rs)$", p) or scripts and p.endswith(".js")):
            got[p] = None, None, "ending"
        elif test(p) or out(p):
            got[p] = None, None, "testdata" if test(p) else "excluded"
        elif crate:
            got[p] = crate, "rust", None
        elif not members:
            got[p] = "my-app", "root", None
        elif member and not all_members and re.search(r"(^|/)(examples?|fixtures?|e2e)(/|$)", member):
            got[p] = None, None, "scaffolding"
        else:
            got[p] = (member, "member", None) if member else ("tooling", "tooling", None)
    return got


@pytest.mark.parametrize("all_members", [False, True])
def test_units_of_files(spark, all_members):
    rnd = random.Random(6)
    names = ["a.ts", "b.rs", "c.js", "d.tsx", "e.test.ts", "f.d.ts", "g.md", "h_qa.rs", "package.json", "i.mjs", "Cargo.toml"]
    folders = ["", "packages/x", "packages/x/deep", "packages/y/src", "apps/web", "apps/web/api", "apps/examples/z", "crates/core", "crates/core/tests", "crates/core/src/in", "testdata/q", "scripts", "dist/x", "examples/one", "packages/fixtures"]
    spaces = ["packages:\n  - 'packages/*' # all\n  - apps/**\nother:\n  - scripts\n", 'packages:\n- "examples/*"\n', None, "catalog:\n  - packages/*\n"]
    rows, want = [], {}
    for k in range(24):
        files = {f"{f}/{n}" if f else n: None for f in folders for n in names if rnd.random() < 0.3 and not (k % 3 == 0 and re.search(r"tsx?$", n))}
        files["package.json"] = '{"name": "My App"}'
        if (text := spaces[k % 4]) is not None:
            files["pnpm-workspace.yaml"] = text
        if k % 5 == 0:
            files["tsconfig.json"] = "{}"
        rows += [(f"r{k}", p, t) for p, t in files.items()]
        want |= {(f"r{k}", p): v for p, v in _plain(list(files.items()), all_members).items()}
    got = D.discover(spark.createDataFrame(rows, "repo string, path string, text string"), all_members).collect()
    assert len(got) == len(rows)
    assert {(r.repo, r.path): (r.unit, r.kind, r.reason) for r in got} == want
    assert {v[1] or v[2] for v in want.values()} >= {"rust", "root", "member", "tooling", "ending", "testdata", "excluded"}


def _sampled(keys, ms, start=(0.0, 0.0, 1.0)):
    keys = sorted(keys, key=lambda k: (k[1], k[0]))
    after = next((i for i, k in enumerate(keys) if k[1] >= ms), None)
    if not keys:
        return None, False, *start, None
    t = keys[-1] if after is None else keys[after]
    s = keys[-1] if after is None else keys[after - 1] if after else None
    since = s[1] if s else 0
    x = 1.0 if after is None or t[1] <= since else min(1.0, max(0.0, (ms - since) / (t[1] - since)))
    a = {"linear": x, "easeOut": 1 - (1 - x) ** 4, "easeInOut": 4 * x**3 if x < 0.5 else 1 - (2 - 2 * x) ** 3 / 2}[t[2]]
    c = start
    if t[3]:
        f = (s and s[3]) or start
        c = f[0] + (t[3][0] - f[0]) * a, f[1] + (t[3][1] - f[1]) * a, math.exp(math.log(f[2]) + (math.log(t[3][2]) - math.log(f[2])) * a)
    return t[0], bool(t[3]), *c, [p + (q - p) * a for p, q in zip((s or t)[4], t[4])]


def test_timelines_between_keyframes(spark):
    rnd = random.Random(3)
    keys, asked = [], []
    for scene in range(12):
        for k in range(rnd.randrange(0, 6)):
            keys.append((scene, f"k{k}", rnd.choice([0, 100, 100, 250, 400]), rnd.choice(["linear", "easeOut", "easeInOut"]), (rnd.random() * 9, 2.0, 0.5 + rnd.random()) if rnd.random() < 0.7 else None, [rnd.random(), 1.0]))
        asked += [(scene, f"s{i}", ms) for i, ms in enumerate((0, 50, 100, 175, 250, 399, 400, 900))]
    df = sample_timelines(
        spark.createDataFrame(keys, "scene int, keyframe string, at_ms long, easing string, camera struct<x: double, y: double, zoom: double>, level array<double>"),
        spark.createDataFrame(asked, "scene int, sample string, at_ms long"),
    )
    got = {(r.scene, r.sample): r for r in df.collect()}
    assert len(got) == len(asked)
    for scene, sample, ms in asked:
        r = got[scene, sample]
        want = _sampled([k[1:] for k in keys if k[0] == scene], ms)
        assert (r.keyframe, r.camera_active) == want[:2]
        assert [r.x, r.y, r.zoom] == pytest.approx(want[2:5])
        assert r["values"] == (want[5] if want[5] is None else pytest.approx(want[5]))


def test_chains_of_any_length_are_walked(spark):
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(70)], "from_id string, to_id string")
    got = shortest_paths(edges, spark.createDataFrame([("n0",)], "source string"))
    assert got.count() == 71 and got.agg({"hops": "max"}).first()[0] == 70


def test_chunks_close_where_the_next_does_not_fit(spark):
    sizes = [3, 4, 5, 20, 1, 9, 1, 10]
    rows = spark.createDataFrame([("k", i, n, i) for i, n in enumerate(sizes)], "k string, at int, size int, id int")
    got = [r.chunk for r in blob_chunks(rows, "k", "at", "size", "id", 10).orderBy("id").collect()]
    assert got == [0, 0, 1, 2, 3, 3, 4, 5]

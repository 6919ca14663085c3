from __future__ import annotations

import datetime as dt
import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strataloom.functions import parsers
from strataloom.functions import secrets as Z
from strataloom.functions import text as X
from strataloom.functions import versions as N
from strataloom.operators import aggregates as A
from strataloom.operators import joins as J
from strataloom.operators import ranking as K
from strataloom.operators import retrieval as T
from strataloom.operators import spatial as P
from strataloom.sources import bundles, files
from strataloom.streaming import stateful as R


def test_last_match_wins_and_clears(spark):
    rules = spark.createDataFrame([(i, J.glob_regex(p), o) for i, (p, o) in enumerate([("*", ["core"]), ("docs/", ["docs"]), ("*.rs", [])])], "rule_no int, pattern_regex string, owners array<string>")
    paths = spark.createDataFrame([("docs/a.md",), ("src/a.rs",), ("x",)], "path string")
    assert {r.path: r.owners for r in J.last_match(paths, rules).collect()} == {"docs/a.md": ["docs"], "x": ["core"]}


def test_longest_prefix_and_suffix(spark):
    f = spark.createDataFrame([("a/b/c.ts",), ("a/x.ts",), ("z.ts",)], "path string")
    d = spark.createDataFrame([("a",), ("a/b",)], "dir string")
    assert {r.path: r.dir for r in J.longest_prefix(f, d).collect()} == {"a/b/c.ts": "a/b", "a/x.ts": "a"}
    k = spark.createDataFrame([("c.ts",), ("b/c.ts",), ("/c.ts",)], "known string")
    assert {r.path: r.known for r in J.longest_suffix(f, k).collect()} == {"a/b/c.ts": "b/c.ts"}


def test_islands_stop_at_the_limit(spark):
    hits = spark.createDataFrame([("p", i, 0 if i % 3 else 1) for i in range(1, 200)] + [("none", 1, 5)], "path string, line int, hits long")
    got = sorted((r.start, r.end) for r in A.islands(hits).collect())
    assert len(got) == 32 and got[0] == (1, 2) and got[-1] == (94, 94)


def test_ledger(spark):
    ev = [("a", "reserved", 1, 5.0), ("a", "settled", 2, 3.0), ("a", "settled", 3, 9.0), ("b", "reserved", 1, 4.0), ("b", "released", 2, 0.0), ("c", "settled", 1, 7.0), ("d", "reserved", 1, 2.0)]
    df = spark.createDataFrame(ev, "request_id string, type string, ts int, amount double")
    assert {r.request_id: (r.amount, r.state) for r in A.settle_ledger(df).collect()} == {"a": (3.0, "settled"), "d": (2.0, "reserved")}


def test_packing_skips_what_does_not_fit(spark):
    rows = spark.createDataFrame([("q", 1, 600, "a"), ("q", 2, 500, "b"), ("q", 3, 300, "c"), ("q", 4, 10, "d")], "q string, place int, size int, id string")
    got = [r.id for r in K.pack_to_budget(rows, "q", "place", "size", "id", 1000, least_left=50).orderBy("position").collect()]
    assert got == ["a", "c", "d"]


def test_cursors():
    c = K.encode_cursor("s", 20)
    assert K.decode_cursor(c, "s") == 20 and K.decode_cursor(None, "s") == 0
    for bad in (c[:-3] + "!!", K.encode_cursor("other", 1), K.encode_cursor("s", -1)):
        with pytest.raises(ValueError, match="invalid-cursor"):
            K.decode_cursor(bad, "s")


def test_collisions_step_over_taken_ids(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a-2"), (4, "a")], "n int, want string")
    got = {r.n: r.unique_id for r in K.number_collisions(df, "want", ["n"]).collect()}
    assert got == {1: "a", 2: "a-3", 3: "a-2", 4: "a-4"}
    many = [(i, "b") for i in range(60)] + [(100 + i, f"b-{i}") for i in range(2, 50, 2)] + [(200, "b-4"), (201, "b-02")]
    ids = [r.unique_id for r in K.number_collisions(spark.createDataFrame(many, "n int, want string"), "want", ["n"]).collect()]
    assert len(set(ids)) == len(ids) and {"b", "b-3", "b-4-2", "b-02"} <= set(ids) and "b-84" in ids and "b-85" not in ids


def test_natural_order(spark):
    df = spark.createDataFrame([("item 10",), ("item 9",), ("Item 100",)], "name string")
    assert [r.name for r in df.orderBy(K.natural_key(F.col("name"))).collect()] == ["item 9", "item 10", "Item 100"]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 400), st.integers(0, 400), st.integers(1, 90), st.integers(1, 900)), min_size=2, max_size=30))
def test_grid_join_equals_all_pairs(spark, boxes):
    df = spark.createDataFrame([(i, float(x), float(y), float(w), float(h)) for i, (x, y, w, h) in enumerate(boxes)], "id long, x double, y double, w double, h double")
    want = {(i, j) for i, a in enumerate(boxes) for j, b in enumerate(boxes) if i < j and a[0] <= b[0] + b[2] and b[0] <= a[0] + a[2] and a[1] <= b[1] + b[3] and b[1] <= a[1] + a[3]}
    got = [(r.a, r.b) for r in P.touching_pairs(df, 50.0, 8).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_stems_and_tokens(spark):
    assert {T.stem_word(w) for w in ("render", "renderer", "renderers", "rendering")} == {"rend"}
    assert [T.stem_word(w) for w in ("scanning", "mapped", "fall", "pass", "stories", "classes")] == ["scan", "map", "fall", "pass", "story", "class"]
    df = spark.createDataFrame([(1, "WASMBridge_getURLParts the 12 a")], "k int, t string")
    assert [r.term for r in T.tokens(df, ["k"], F.col("t")).orderBy("position").collect()] == ["wasm", "bridg", "url", "part"]


def test_redaction_comes_before_the_cut(spark):
    t = "x" * 10 + " ghp_" + "a" * 30
    got = spark.createDataFrame([(t,)], "t string").select(Z.redact(F.col("t"), 20).alias("r")).first().r
    assert "ghp_" not in got and len(got) <= 20


def test_values_are_masked_whole():
    cases = {
        '{"user_id": {"a": [1, "}"], "b": "x\\"}"}, "n": 2}': '{"user_id": "[redacted]", "n": 2}',
        '{"org_id": ["a]", {"b": 1}], "n": 2}': '{"org_id": "[redacted]", "n": 2}',
        '{"account_id": "a \\"b\\" c", "n": 2}': '{"account_id": "[redacted]", "n": 2}',
        r'{"m": "{\"api_key\": \"a\\\"b\", \"n\": 1}"}': r'{"m": "{\"api_key\": \"[redacted]\", \"n\": 1}"}',
        r'"{\"user_id\": {\"x\": \"}\"}, 1}"': r'"{\"user_id\": \"[redacted]\", 1}"',
        r'"{\\\"email\\\": \\\"a\\\\\\\"z\\\"}"': r'"{\\\"email\\\": \\\"[redacted]\\\"}"',
        "user_id: {not closed, n": "user_id: \"[redacted]\", n",
        "organisation_id='a b\nc'": "organisation_id='[redacted]'",
        "e-mail: must be given": "e-mail: must be given",
        "email=must": "email=[redacted]",
        "x_user_id=[redacted]": "x_user_id=[redacted]",
        "superuser_id": "superuser_id",
        "the user spoke, user abc_12 too": "the user spoke, user [redacted] too",
    }
    assert {k: Z.mask_values(k) for k in cases} == cases
    assert all(Z.mask_values(v) == v for v in cases.values() if "not closed" not in v)


@settings(max_examples=200, deadline=None)
@given(st.recursive(st.text(st.sampled_from("ab\"\\}]{[ "), max_size=6) | st.integers(), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(st.sampled_from("ab"), max_size=2), x, max_size=3), max_leaves=8), st.integers(0, 2))
def test_any_value_goes_whole_at_any_escape_depth(value, depth):
    value = value if isinstance(value, (dict, list)) else f"v{value}"
    made, want = ({"a": 1, "user_id": v, "z": "end"} for v in (value, "[redacted]"))
    text, goal = json.dumps(made), json.dumps(want)
    for _ in range(depth):
        text, goal = json.dumps(text), json.dumps(goal)
    assert Z.mask_values(text) == goal


def test_specs(spark):
    cases = {
        "git+https://user:se/cret@host/r": "git+https://[redacted]@host/r",
        "https://u:p@h/r?x=1#main": "https://[redacted]@h/r?[redacted]#main",
        "ssh://git@github.com/a/b.git#v1": "ssh://git@github.com/a/b.git#v1",
        "https://h/r#semver:^1.2": "https://h/r#semver:^1.2",
        "https://h/r#auth_x": "https://h/r#[redacted]",
        "https://h:8080/r@2": "https://h:8080/r@2",
        "https://h:/r@2": "https://[redacted]@2",
        "file:/home/me/x": "file:<absolute path>",
        "~/x": "<absolute path>",
        "C:\\x": "<absolute path>",
        "/x\ny": "<absolute path>",
        "file:../x": "file:../x",
        "ghp_" + "a" * 30: "[redacted-token]",
        "npm:a@^1": "npm:a@^1",
        "^1.2\tx": "^1.2 x",
        "": "",
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", Z.redact_spec(F.col("t")).alias("r"))
    assert {r.t: r.r for r in df.collect()} == cases


def test_redaction_by_shape_and_by_key(spark):
    cases = {
        "github_pat_" + "a1" * 15: "[redacted-token]",
        "x glpat-" + "b" * 20 + " y": "x [redacted-token] y",
        "npm_" + "c" * 36: "[redacted-token]",
        "sk-" + "d" * 20: "[redacted-key]",
        "Authorization: bearer abcdefgh12": "Authorization: Bearer [redacted]",
        "mail bob.smith@a.example.org, please": "mail [redacted-email], please",
        "a@b.c1 stays": "a@b.c1 stays",
        "user_2fAb3456789012345678": "[redacted-id]",
        "user_service2": "user_service2",
        "org-AbCdEfGhIjKl9": "[redacted-id]",
        '{"user_id": "u-1", "n": 2}': '{"user_id": "[redacted]", "n": 2}',
        "end_user_id=abc": "end_user_id=[redacted]",
        "account: prose goes on": "account: prose goes on",
        "account: bobby.tables": "account: [redacted]",
        "organization org77x": "organization [redacted]",
        "see /home/ann/x": "see /home/[user]/x",
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", Z.redact(F.col("t")).alias("r"))
    assert {r.t: r.r for r in df.collect()} == cases
    assert {r.r: r.s for r in df.select("r", Z.redact(F.col("r")).alias("s")).collect()} == {v: v for v in cases.values()}


def _plain_requirement(need, have):
    """Term by term over tuples, for versions of three numbers."""
    v = tuple(map(int, have.split(".")))
    for term in filter(None, (x.strip() for x in need.split(","))):
        op = term[: len(term) - len(term.lstrip("^~<>="))]
        given = [int(x) for x in term.lstrip("^~<>= ").split(".") if x != "*"]
        low = tuple(given + [0] * (3 - len(given)))
        if not given:
            continue
        if "*" in term or op == "=":
            fits = list(v[: len(given)]) == given
        elif op == "~":
            fits = v >= low and list(v[: min(2, len(given))]) == given[:2]
        elif op in ("", "^"):
            fixed = next((i + 1 for i, x in enumerate(given) if x), len(given))
            fits = v >= low and list(v[:fixed]) == given[:fixed]
        else:
            fits = {">": v > low, ">=": v >= low, "<": v < low, "<=": v <= low}[op]
        if not fits:
            return False
    return True


def test_requirements_equal_a_plain_reading(spark):
    rnd = random.Random(7)
    number = lambda: str(rnd.randrange(3))
    term = lambda: rnd.choice(["", "^", "~", "=", ">", ">=", "<", "<=", ">= "]) + ".".join(number() for _ in range(rnd.randrange(1, 4)))
    rows = [(", ".join(term() for _ in range(rnd.randrange(1, 3))), ".".join(number() for _ in range(3))) for _ in range(800)]
    rows += [(need, have) for need in ("*", "1.*", "1.2.*", ">=1,", ">1", "<=1", "^0", "^0.0") for have in ("0.0.1", "1.0.0", "1.5.0", "1.2.9", "2.0.0")]
    df = spark.createDataFrame(rows, "need string, have string")
    for r in df.select("*", N.requirement_matches(F.col("need"), F.col("have")).alias("ok")).collect():
        assert r.ok == _plain_requirement(r.need, r.have), r
    odd = spark.createDataFrame([("one", "1.0.0"), ("1", "bad"), ("1", None), (None, "1.0.0"), ("^1.2.0-rc.1", "1.3.0-beta")], "need string, have string")
    assert [r.ok for r in odd.select(N.requirement_matches(F.col("need"), F.col("have")).alias("ok")).collect()] == [None, None, None, None, True]


def test_lock_versions(spark):
    cases = {"link:../pkg@1.2.3": ("local", None), "file:x": ("local", None), "18.2.0_react@17.0.2": ("version", "18.2.0"), "/a@1.2.3(b@2.0.0)": ("version", "1.2.3"), "'v1.2.3'": ("version", "1.2.3"), "https://h/x.tgz": ("source", None), "npm:x@1.0.0-rc.1": ("version", "1.0.0-rc.1")}
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", N.lock_version(F.col("t")).alias("x"))
    assert {r.t: (r.x.kind, r.x.version) for r in df.collect()} == cases


def test_recent_deliveries_equal_an_lru(spark):
    rnd = random.Random(4)
    rows = [(i, f"k{int(rnd.paretovariate(0.6)) % 60}" if rnd.random() < 0.98 else None) for i in range(900)]
    for keep in (1, 5, 20):
        seen, want = {}, []
        for i, k in rows:
            if k not in seen:
                want.append(i)
            seen.pop(k, None)
            seen[k] = None
            if len(seen) > keep:
                del seen[next(iter(seen))]
        df = spark.createDataFrame(rows, "i long, k string").repartition(6)
        assert sorted(r.i for r in R.dedupe_recent(df, "k", "i", keep, chunk_rows=70).collect()) == want
    one = spark.createDataFrame([(10, "a"), (1000, "b"), (2000, "a")], "i long, k string")
    assert sorted(r.i for r in R.dedupe_recent(one, "k", "i").collect()) == [10, 1000]


def test_folds_keep_large_ids_and_null_keys(spark):
    big = 2**60
    rows = [(big + 1, big + 3, dt.datetime(2024, 1, 1, 0, 0, 1)), (None, big + 5, dt.datetime(2024, 1, 1, 0, 0, 2)), (None, big + 7, dt.datetime(2024, 1, 1, 0, 0, 3)), (big + 1, None, dt.datetime(2024, 1, 1, 0, 0, 4))]
    got = R.limiter(spark.createDataFrame(rows, "k long, i long, t timestamp"), "k", "t", "i", 60, 1)
    assert {(r.k, r.i, r.admitted) for r in got.collect()} == {(big + 1, big + 3, True), (big + 1, None, False), (None, big + 5, True), (None, big + 7, False)}


def test_patches_need_their_base(spark):
    rows = [("s", 1, 0, 1), ("s", 2, 0, 2), ("s", 3, 1, 1), ("s", 4, 1, 5), ("s", 5, 5, 6), ("t", 1, 3, 4)]
    got = R.patch_status(spark.createDataFrame(rows, "scene string, arrival int, base_revision int, revision int"))
    assert {(r.scene, r.arrival): r.status for r in got.collect()} == {("s", 1): "applied", ("s", 2): "revisionMismatch", ("s", 3): "nonIncreasing", ("s", 4): "applied", ("s", 5): "applied", ("t", 1): "revisionMismatch"}


def test_addresses():
    assert parsers.client_key("::ffff:10.0.0.1") == "10.0.0.1" and parsers.client_key("2001:db8::1") == "2001:db8::/64" and parsers.client_key("?") == "?"


def test_parsers():
    assert files.parse_yarn('"@a/b@^1", "@a/b@^2":\n  version "2.1.0"\n\nc@1:\n  version "1.0.0"\n') == [("@a/b", "^1", "2.1.0"), ("@a/b", "^2", "2.1.0"), ("c", "1", "1.0.0")]
    assert files.parse_cargo_toml('[dependencies]\na = "1"\nb = { package = "c", version = "2", optional = true }\n[target."cfg(unix)".dependencies]\nd = "3"\n') == [
        ("dependencies", "a", "a", "1", False), ("dependencies", "b", "c", "2", True), ("dependencies", "d", "d", "3", False)]
    facts = files.parse_mermaid("graph TD\n a[Start] --> b(End)\n b -->|yes| c\n")
    assert ("edge", "b>c", "yes", "b", "c") in facts and ("node", "a", "Start", None, None) in facts
    with pytest.raises(ValueError):
        files.parse_mermaid("\n".join(f"a{i} --> b{i}" for i in range(300)))


def test_bad_files_give_no_rows(spark):
    df = spark.createDataFrame([("x", "not = = toml"), ("y", None), ("z", '[[package]]\nname = "a"\nversion = "1.0.0"\n')], "path string, text string")
    assert [(r.path, r.name) for r in files.parsed(df, "cargo_lock").collect()] == [("z", "a")]


    assert [(r.path, r.error.split(":")[0]) for r in files.unreadable(df, "cargo_lock").collect()] == [("x", "TOMLDecodeError")]


def test_owner_lines(spark):
    text = "\ufeff* @core @core\r\n!no @x\ndocs/my\\ file @b @a me@x.org word # note\n# none\nempty/\n"
    got = files.owner_rules(spark.createDataFrame([("CODEOWNERS", text)], "path string, text string")).orderBy("rule_no").collect()
    assert [(r.pattern, r.owners) for r in got] == [("*", ["@core"]), ("docs/my file", ["@a", "@b", "me@x.org", "word"]), ("empty/", [])]
    rules = spark.range(5).selectExpr("int(id) AS rule_no", "'^a' AS pattern_regex", "array('o') AS owners")
    with pytest.raises(ValueError, match="rules"):
        J.last_match(spark.createDataFrame([("a",)], "path string"), rules, most_rules=4)


@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6)), min_size=2, max_size=25))
def test_agreement_equals_all_pairs(rows):
    sign = lambda x: (x > 0) - (x < 0)
    pairs = [sign(p[0] - q[0]) * sign(p[1] - q[1]) for i, p in enumerate(rows) for q in rows[:i]]
    assert abs(A.agreement([a for a, _ in rows], [b for _, b in rows]) - sum(pairs) / len(pairs)) < 1e-12


def test_publish_is_immutable(spark, tmp_path):
    df = spark.range(3)
    bundles.publish(df, str(tmp_path), "s", "v1")
    with pytest.raises(Exception, match="exists"):
        bundles.publish(df, str(tmp_path), "s", "v1")
    assert bundles.read_latest(spark, str(tmp_path), "s").count() == 3


def test_limiter_windows_start_at_the_first_event():
    ok, start, used = R.admit_fixed([0, 1, 2, 9, 10, 11, 19.9, 20], 10, 2)
    assert ok == [True, True, False, False, True, True, False, True] and (start, used) == (20, 1)


def test_debounce_gap_and_patches(spark):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    ev = spark.createDataFrame([("k", at(0)), ("k", at(9)), ("k", at(19)), ("k", at(40))], "k string, ts timestamp")
    assert sorted(r.events for r in R.debounce(ev, "k", "ts", 10).collect()) == [1, 3]
    base = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "id string, value double")
    patch = spark.createDataFrame([(1, "upsert", "a", 5.0), (2, "remove", "b", None), (3, "upsert", "c", 7.0), (4, "remove", "c", None)], "revision int, op string, id string, value double")
    assert {(r.id, r.value) for r in R.apply_patches(base, patch).collect()} == {("a", 5.0)}


def test_debounce_over_a_stream(spark, tmp_path):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    spark.createDataFrame([("k", at(0)), ("k", at(5)), ("k", at(100)), ("k", at(1000))], "k string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, ts timestamp").parquet(str(tmp_path / "in")).withWatermark("ts", "1 second")
    q = R.debounce(stream, "k", "ts", 10).writeStream.format("memory").queryName("bursts").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.events for r in spark.table("bursts").collect()) == [1, 2]


def test_lod_hysteresis(spark):
    z = [5, 12, 9, 7, 12, 16]
    df = spark.createDataFrame([("k", i, float(v)) for i, v in enumerate(z)], "k string, n int, z double")
    assert [r.level for r in R.lod_levels(df, "k", "n", "z", (10.0,), 2.0).orderBy("n").collect()] == [0, 1, 1, 0, 1, 1]


def test_routes_are_cheapest(spark):
    rnd = random.Random(9)
    for _ in range(30):
        walls = {(rnd.randrange(6), rnd.randrange(6)) for _ in range(9)} - {(0, 0), (5, 5)}
        # Brute force: Bellman-Ford over (cell, direction).
        steps = ((1, 0), (0, 1), (-1, 0), (0, -1))
        cost = {((0, 0), -1): 0.0}
        for _ in range(80):
            for (at, way), c in list(cost.items()):
                for turn, (dx, dy) in enumerate(steps):
                    to = (at[0] + dx, at[1] + dy)
                    if to not in walls and 0 <= to[0] < 6 and 0 <= to[1] < 6:
                        price = c + 1 + (3 if way not in (-1, turn) else 0)
                        cost[to, turn] = min(cost.get((to, turn), 1e9), price)
        want = min((c for (at, _), c in cost.items() if at == (5, 5)), default=None)
        got = P.route((0, 0), (5, 5), walls, (6, 6))
        assert (got[0] if got else None) == want


def test_limiter_over_a_stream(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    ev = [("a", at(s), i) for i, s in enumerate([0, 1, 2, 9, 10, 11, 20])] + [("b", at(3), 100)]
    for k in (0, 1):  # two batches: the window's state lives on
        spark.createDataFrame(ev[k * 4 : k * 4 + 4], "key string, ts timestamp, id long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, ts timestamp, id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = R.limiter_stream(stream, 10, 2).writeStream.format("memory").queryName("admitted").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert {r.id: r.admitted for r in spark.table("admitted").collect()} == {0: True, 1: True, 2: False, 3: False, 4: True, 5: True, 6: True, 100: True}

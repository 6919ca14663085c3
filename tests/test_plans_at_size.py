"""What plans may not do, whatever the planner takes a table's size for: broadcast rows that grow, or read the same texts often."""

from __future__ import annotations

import pytest

from strataloom import plans

SF = "/root/testdata/sf0.01"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name, reads", [("s18_imports", 1), ("s19_declarations", 1), ("t20_clone_fingerprints", 3), ("t21_keyword_complexity", 3), ("t22_signature_change", 4), ("s20_rust_outline", 2)])
def test_token_tables_are_read_few_times_and_not_broadcast(spark, name, reads):
    plan = _plan(plans.QUERIES[name](spark, SF))
    assert (plan.count("BroadcastExchange"), max(plan.count("MapInArrow"), reads)) == (0, reads)


def test_innermost_span_follows_the_sql_for_ids_of_a_million_and_more(spark, tmp_path):
    import duckdb

    duckdb.sql(f"COPY (SELECT range * 7919 + 100 AS event_id, 1::BIGINT AS user_id, CASE WHEN range % 2 = 0 THEN 'view' ELSE 'click' END AS event_type FROM range(3000)) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    got = {r.point_id: r.span_id for r in plans.QUERIES["j9_innermost_span"](spark, str(tmp_path)).collect()}
    duckdb.sql(f"CREATE OR REPLACE TEMP VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    want = dict(duckdb.sql(plans.ORACLES["j9_innermost_span"]).fetchall())
    assert got == want and got


@pytest.mark.parametrize("name", ["s6_discovery", "p6_geometry_findings"])
def test_files_and_drawings_are_not_broadcast(spark, name):
    assert "BroadcastExchange" not in _plan(plans.QUERIES[name](spark, SF))


def test_key_difference_groups_once(spark):
    plan = _plan(plans.QUERIES["u2_key_difference"](spark, SF))
    assert plan.count("Exchange") == 1 and plan.count("HashAggregate") == 2


def test_words_are_counted_where_their_text_lies(spark):
    from pyspark.sql import functions as F

    from strataloom.operators import retrieval as R
    from strataloom.operators import sections as S

    texts = spark.createDataFrame([(1, "f", "text")], "doc int, field string, text string")
    plan = _plan(R.term_counts(texts, ["doc"], F.col("text")))
    assert (plan.count("Exchange"), plan.count("ArrowEvalPython"), plan.count("MapInArrow")) == (1, 0, 1)
    symbols = spark.createDataFrame([("q", "f", 1, "p", "n", "b", 1.0)], "q string, file string, doc int, path string, name string, body string, score double")
    assert "ArrowEvalPython" not in _plan(S.symbol_order(symbols, spark.createDataFrame([("q", "b")], "q string, term string")))


def test_counts_in_place_are_those_of_the_columns(spark):
    from pyspark.sql import functions as F

    from strataloom.operators import retrieval as R

    odd = ["getURLParts_HTMLParser x1Y2 aBcD", "İstanbul 5K Kelvin Étatés ΣΣa", "", None, "uses using DOES 12 12a a", "A" * 400 + "bC", "WASMBridgeİzAbC fooBAR"]
    df = spark.createDataFrame(list(enumerate(odd)), "doc int, text string")
    plain = R._stemmed(df.select("doc", F.explode(F.concat(R.raw_tokens(F.col("text")), R.compounds(F.col("text")))).alias("term"))).groupBy("doc", "term").agg(F.count("*").alias("tf"))
    assert sorted(map(tuple, R.term_counts(df, ["doc"], F.col("text")).collect())) == sorted(map(tuple, plain.collect()))


def test_fields_of_a_document_may_come_in_parts(spark):
    from strataloom.operators import retrieval as R

    parts = spark.createDataFrame([(1, "name", "alpha beta"), (1, "name", "alpha"), (2, "excerpt", None), (1, "excerpt", "beta")], "doc int, field string, text string")
    whole = spark.createDataFrame([(1, "name", "alpha beta alpha"), (2, "excerpt", ""), (1, "excerpt", "beta")], "doc int, field string, text string")
    got = [[sorted(map(tuple, df.collect())) for df in R.build_index(x)] for x in (parts, whole)]
    assert got[0] == got[1] and got[0][2] == [(2,)] and got[0][1] == [("alpha", 1), ("beta", 1)]


def test_boxes_are_dealt_over_tasks_and_pairs_need_no_distinct(spark):
    plan = _plan(plans.QUERIES["j14_grid_join"](spark, SF))
    assert "BroadcastExchange" not in plan and "HashAggregate" not in plan and "REPARTITION_BY_NUM" in plan


def test_boxes_of_three_sizes_pair_once(spark):
    import random

    from strataloom.operators.spatial import touching_pairs

    r = random.Random(3)
    kinds = [(5.0, 5.0), (60.0, 7.0), (900.0, 30.0), (30.0, 3000.0), (3500.0, 3500.0)]
    boxes = [(i, float(r.randrange(4000)), float(r.randrange(4000)), *kinds[i % 5]) for i in range(300)]
    want = sorted((a[0], b[0]) for a in boxes for b in boxes if a[0] < b[0] and a[1] <= b[1] + b[3] and b[1] <= a[1] + a[3] and a[2] <= b[2] + b[4] and b[2] <= a[2] + a[4])
    got = touching_pairs(spark.createDataFrame(boxes, "id int, x double, y double, w double, h double"), 16.0, 4)
    assert sorted(map(tuple, got.collect())) == want


def test_paths_are_not_aggregated(spark, monkeypatch):
    from strataloom.operators import graph as G

    made, keep = [], G.written
    monkeypatch.setattr(G, "written", lambda df: made.append(_plan(df)) or keep(df))
    arcs = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "a"), ("d", "d")], "from_id string, to_id string")
    got = {(r.source, r.node): r.path for r in G.shortest_paths(arcs, spark.createDataFrame([("a",), ("c",)], "source string")).collect()}
    assert got["a", "d"] == ["a", "b", "d"] and got["c", "b"] == ["c", "d", "a", "b"] and len(got) == 8
    assert made and not any("min(path" in p for p in made)


def test_paths_of_tests_are_dealt_by_number_and_not_broadcast(spark):
    plan = _plan(plans.QUERIES["x24_nearby_tests"](spark, SF))
    assert "BroadcastExchange" not in plan and plan.count("REPARTITION_BY_NUM") == 2


def test_flows_are_made_once(spark):
    assert "lineitem.parquet" not in _plan(plans.QUERIES["j4_incident"](spark, SF))


def test_texts_do_not_travel_with_the_questions_that_match_them(spark, monkeypatch):
    from strataloom.operators import answers as Q
    from strataloom.operators import sections as S

    seen, keep = [], S.symbol_order
    monkeypatch.setattr(S, "symbol_order", lambda *a: seen.append(a) or keep(*a))
    entity = "id string, name string, kind string, parent_id string, path string, start_line int, end_line int, symbols array<string>, summary string, key_points array<string>, excerpt_start int, lines array<string>"
    row = lambda i, kind, up, lines: (i, i, kind, up, "a.ts", 1, 9, [], None, None, 1, lines)
    documents = spark.createDataFrame([row("box", "container", None, None), row("f", "component", "box", None), row("x", "code", "f", ["alpha beta"]), row("y", "code", "f", None), row("z", "code", "f", ["beta alpha alpha"])], entity)
    ranked = spark.createDataFrame([(q, "f", "component", 1.0, 1) for q in "ab"], "q string, doc string, kind string, score double, place int")
    inside = spark.createDataFrame([(q, "f", d, 1.0) for q in "ab" for d in "xyz"], "q string, file string, doc string, score double")
    terms = spark.createDataFrame([("a", "alpha"), ("b", "beta")], "q string, term string")
    got = {r.q: r for r in Q.pack_sections(ranked, inside, documents, terms).collect()}
    assert [s.id for s in got["a"].symbols] == ["z", "x", "y"] and [s.id for s in got["b"].symbols] == ["x", "z", "y"]
    assert "beta alpha alpha" in got["a"].excerpt
    symbols, _, bodies = seen[0]
    assert "body" not in symbols.columns and bodies.groupBy("doc").count().where("count > 1").isEmpty()
    with_body = symbols.join(bodies.select("doc", "body"), "doc")
    assert sorted(map(tuple, keep(symbols, terms, bodies).collect())) == sorted(map(tuple, keep(with_body, terms).collect()))


def test_chunks_are_bisected_and_only_needed_columns_are_folded(spark):
    from pyspark.sql import functions as F

    from strataloom.streaming import stateful as R

    cuts = [float(3 * i) for i in range(37)]
    ends = F.array(*map(F.lit, cuts))
    at = spark.createDataFrame([(x,) for x in [None, -1.0, 0.0, 0.5, *(float(i) for i in range(1, 120)), float("nan")]], "at double")
    assert at.where(~R._cuts_below(ends, len(cuts), F.col("at")).eqNullSafe(F.size(F.filter(ends, lambda c: c < F.col("at"))))).isEmpty()
    plan = _plan(plans.QUERIES["r3_delivery_dedupe"](spark, SF))
    assert "props" not in plan and "filter(" not in plan


def test_files_of_a_consumer_meet_by_order(spark, tmp_path):
    import duckdb

    plan = _plan(plans.QUERIES["a3_consumer_report"](spark, SF))
    assert plan.count("REPARTITION_BY_NUM") == 3 and "SortMergeJoin [l_orderkey" in plan
    # Repeated orders and lines count as often as they come, their files once.
    duckdb.sql(f"COPY (SELECT range % 7 AS l_orderkey, range % 3 AS l_suppkey, CASE WHEN range % 5 = 0 THEN NULL WHEN range % 2 = 0 THEN 'N' ELSE 'R' END AS l_returnflag FROM range(60)) TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    duckdb.sql(f"COPY (SELECT range % 7 AS o_orderkey, range % 4 % 3 AS o_custkey FROM range(20)) TO '{tmp_path}/orders.parquet' (FORMAT parquet)")
    duckdb.sql(f"COPY (SELECT range AS s_suppkey FROM range(2)) TO '{tmp_path}/supplier.parquet' (FORMAT parquet)")
    got = plans.QUERIES["a3_consumer_report"](spark, str(tmp_path))
    for name in ("lineitem", "orders", "supplier"):
        duckdb.sql(f"CREATE OR REPLACE TEMP VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    want = sorted(duckdb.sql(plans.ORACLES["a3_consumer_report"]).fetchall())
    assert sorted(map(tuple, got.collect())) == want and want


def test_relations_are_made_once_and_merged_with_the_tree(spark):
    from strataloom import adapters as A
    from strataloom.operators import graph as G
    from strataloom.plans.registry import Tables

    t = Tables(spark, SF)
    plan = _plan(G.lifted(A.relations(t), A.entities(t), 2))
    assert "SortMergeJoin [from_id" in plan and "SortMergeJoin [to_id" in plan
    assert _plan(plans.QUERIES["g6_band_projection"](spark, SF)).count("lineitem.parquet") == 1


def test_chains_of_leaves_hang_below_inner_nodes(spark):
    from strataloom.operators import graph as G

    tree = [("a", None), ("b", "a"), ("c", "b"), ("d", "c"), ("x", "y"), ("y", "x"), ("z", "y"), ("lost", "gone")]
    got = {r.id: (r.chain, r.back) for r in G.chains(spark.createDataFrame(tree, "id string, parent_id string")).collect()}
    assert got == {
        "a": (["a"], None), "b": (["b", "a"], None), "c": (["c", "b", "a"], None), "d": (["d", "c", "b", "a"], None),
        "x": (["x", "y"], "x"), "y": (["y", "x"], "y"), "z": (["z", "y", "x"], "y"), "lost": (["lost"], None),
    }


def test_records_of_a_coverage_file_need_no_window(spark):
    from strataloom.sources import files

    text = "DA:9,9\nTN:\nSF:a.ts\r\nDA:1,2\r\nLF:3\nLH:1\nend_of_record\nxSF:no\nSF:DA:1,7\nDA:2,0\nSF:\nSF:last"
    hits, stored = files.coverage_records(spark.createDataFrame([("f", text), ("g", None)], "path string, text string"))
    assert sorted(map(tuple, hits.collect()), key=repr) == [("DA:1,7", 2, 0), ("a.ts", 1, 2), (None, 9, 9)]
    assert sorted(map(tuple, stored.collect())) == [("", None, None), ("DA:1,7", None, None), ("a.ts", 3, 1), ("last", None, None)]
    assert "Window" not in _plan(hits) + _plan(stored)


def test_bundle_files_are_compressed_and_in_order(spark, tmp_path):
    import gzip
    import json

    from strataloom.sources import bundles

    entities = spark.createDataFrame([("b", "k", 1, None, None), ("a", "k", 0, "b", "n")], bundles.ENTITY.removeprefix("struct<").removesuffix(">"))
    relations = spark.createDataFrame([("y", "a", "b", "uses"), ("x", "b", "a", "calls")], bundles.RELATION.removeprefix("struct<").removesuffix(">"))
    bundles.write_bundle(entities, relations, "s", str(tmp_path / "out"))
    rows = [json.loads(line) for f in sorted((tmp_path / "out").glob("part-*.json.gz")) for line in gzip.open(f, "rt")]
    assert [(r["fact"], r["id"]) for r in rows] == [("entity", "a"), ("entity", "b"), ("relation", "x"), ("relation", "y")]
    assert json.loads(rows[1]["body"]) == {"id": "b", "kind": "k", "rank": 1} and json.loads(rows[2]["body"]) == {"id": "x", "from_id": "b", "to_id": "a", "kind": "calls"}
    assert [sorted(map(tuple, df.drop("snapshot").collect())) for df in bundles.read_bundle(spark, str(tmp_path / "out"))] == [sorted(map(tuple, entities.collect())), sorted(map(tuple, relations.collect()))]


def test_tokens_of_scripts_are_never_shuffled(spark):
    # One exchange deals the table over tasks; copies are counted by fingerprint.
    plan = _plan(plans.QUERIES["t20_clone_fingerprints"](spark, SF))
    assert plan.count("MapInArrow") == 1 and plan.count("Exchange") == 2 and "hashpartitioning(fingerprint" in plan and "Join" not in plan and "Window" not in plan


def test_complexity_shuffles_files_alone(spark):
    plan = _plan(plans.QUERIES["t21_keyword_complexity"](spark, SF))
    assert plan.count("MapInArrow") == 1 and plan.count("Exchange") == 1 and "Join" not in plan and "Window" not in plan


def test_numbers_of_paths_are_sent_once_for_a_block(spark, monkeypatch):
    from strataloom.operators import graph as G

    made, keep = [], G.written
    monkeypatch.setattr(G, "written", lambda df: made.append(_plan(df)) or keep(df))
    arcs = [(f"s{i}", f"m{j}") for i in range(3) for j in range(20)] + [(f"m{j}", f"t{k:02d}") for j in range(20) for k in range(30)] * 2 + [("t07", "z"), ("t07", "s1")]
    df, starts = spark.createDataFrame(arcs, "from_id string, to_id string").repartition(5), spark.createDataFrame([("s0",), ("s1",), ("s2",)], "source string")
    for few in (0, G.FEW_NODES):
        made.clear()
        monkeypatch.setattr(G, "FEW_NODES", few)
        got = {(r.source, r.node): r.path for r in G.shortest_paths(df, starts).collect()}
        assert len(got) == 3 * (1 + 20 + 30 + 1) + 2 and got["s2", "t29"] == ["s2", "m0", "t29"] and got["s0", "s1"] == ["s0", "m0", "t07", "s1"] and got["s1", "z"] == ["s1", "m0", "t07", "z"]
        # Each hop deals rows over blocks and takes the least numbers there.
        hops = [p for p in made if "REPARTITION_BY_NUM" in p and "Window" in p]
        assert len(hops) == 4 and not any("hashpartitioning(next" in p or "LeftAnti" in p for p in hops)


def test_scores_are_added_up_where_postings_of_a_document_lie(spark):
    import re

    from strataloom.operators import retrieval as R

    fields = spark.createDataFrame([(1, "name", "alpha beta"), (1, "excerpt", "beta"), (2, "name", "alpha"), (3, "summary", "gamma")], "doc int, field string, text string")
    postings, vocabulary, size = R.build_index(fields)
    asked = spark.createDataFrame([("a", "alpha", "alpha", 1.0), ("a", "beta", "beta", 1.0), ("b", "alpha", "alpha", 0.6)], "q string, token string, term string, weight double")
    scores = R.bm25f(asked, postings, vocabulary, size)
    plan = _plan(scores)
    assert len(re.findall(r"hashpartitioning\(doc#\d+, ", plan)) == 1 and not re.search(r"hashpartitioning\(q#\d+, doc#", plan)
    assert {(r.q, r.doc) for r in scores.collect()} == {("a", 1), ("a", 2), ("b", 1), ("b", 2)}


def test_pairs_of_questions_and_documents_meet_their_places_once(spark, monkeypatch):
    from strataloom.operators import answers as Q

    made, keep = [], Q.written
    monkeypatch.setattr(Q, "written", lambda df: made.append(_plan(df)) or keep(df))
    place = spark.createDataFrame([("box", "container", None, "box", "box"), ("f", "component", "box", "f", "box"), ("g", "component", "box", "g", "box"), ("x", "code", "f", "f", "box"), ("y", "code", "f", "f", "box"), ("z", "code", "g", "g", "box")], "doc string, kind string, parent_id string, file string, container string")
    base = spark.createDataFrame([("a", "x", 2.0), ("a", "y", 1.0), ("a", "f", 0.5), ("b", "z", 1.0)], "q string, doc string, score double")
    relations = spark.createDataFrame([("x", "z", "calls")], "from_id string, to_id string, kind string")
    ranked, inside = Q.ranked_files(base, place, relations)
    assert sorted(map(tuple, inside.select("q", "file", "doc", "score").collect())) == [("a", "f", "x", 2.0), ("a", "f", "y", 1.0), ("b", "g", "z", 1.0)]
    # f: its own 0.5, its best child's 2 and a tenth of the next one; the box: a fifth of f; g: lifted by x, and a later one of its box.
    got = {(r.q, r.doc): round(r.score, 6) for r in ranked.collect()}
    assert got == {("a", "f"): 2.6, ("a", "g"): round(2.0 * 0.9 * 0.95, 6), ("a", "box"): round(2.6 * 0.2 * 0.95**2, 6), ("b", "g"): 1.0, ("b", "f"): round(0.9 * 0.95, 6), ("b", "box"): round(0.2 * 0.95**2, 6)}
    assert made and "Join" not in _plan(inside)

"""Every rule of explanations, tables and diagrams has a broken row."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataloom.operators import validate as V


def _faults(df):
    return {r.id: r.fault for r in df.collect()}


def test_active_markup(spark):
    cases = {
        "the <summary> field": False, "<p> and </p>": False, "a < b > c": False, "`<script>` in code": False, "Map<string, x>": False,
        "<script>": True, "</SCRIPT >": True, "<svg/onload=x>": True, "<!-- x -->": True, "<dialog open>": True, "<foo a=1>": True, "<a href='x'>": True, "<foo bar>": False,
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.m for r in df.select("t", V.active_markup(F.col("t")).alias("m")).collect()} == cases


def test_explanations(spark):
    ok = ["one", "two"]
    rows = [
        ("fine", "Prose.\r\n\r\n\r\n\r\nMore.", ["- one", "2) two", " "], None), ("none", None, ok, "no summary"), ("blank", " \n ", ok, "no summary"), ("markup", "a <script> b", ok, "markup"), ("long", "x" * 601, ok, "long summary"),
        ("edge", "x" * 600, ok, None), ("bullets", "\n".join(["- x"] * 7), ok, "bullets"), ("points", "p", None, "no key points"), ("marked", "p", ["<b a=1>", "two"], "markup"), ("big", "p", ["x" * 221, "two"], "long key point"),
        ("few", "p", ["one", " "], "key points"), ("many", "p", ["x"] * 6, "key points"),
    ]
    df = spark.createDataFrame([r[:3] for r in rows], "id string, summary string, key_points array<string>")
    assert _faults(V.explanations(df)) == {r[0]: r[3] for r in rows if r[3]}


def test_tables(spark):
    head, body = ["a", "b"], [["1", "2"]]
    rows = [
        ("fine", "c", head, body, None), ("bare", None, head, body, None), ("parts", None, head, None, "parts"), ("caption", "x" * 121, head, body, "caption"), ("narrow", None, ["a"], [["1"]], "columns"), ("wide", None, list("abcde"), [list("abcde")], "columns"),
        ("blank", None, ["a", " "], body, "headings"), ("heading", None, ["a", "x" * 41], body, "headings"), ("empty", None, head, [], "rows"), ("tall", None, head, body * 9, "rows"), ("ragged", None, head, [["1", "2"], ["1"]], "widths"),
        ("hole", None, head, [["1", None]], "cells"), ("cell", None, head, [["1", "x" * 161]], "cells"), ("markup", None, head, [["1", "<img src=x>"]], "markup"),
    ]
    df = spark.createDataFrame([r[:4] for r in rows], "id string, caption string, columns array<string>, rows array<array<string>>")
    assert _faults(V.tables(df)) == {r[0]: r[4] for r in rows if r[4]}


def test_flowcharts(spark):
    h = "flowchart LR\n"
    rows = [
        ("fine", h + 'a["One; two"] -->|uses| b(Two)\nsubgraph s\nb -- text --> c{Three}\nend', None), ("fence", "```mermaid\nflowchart TD;\na --> b\n```", None), ("none", None, "no source"), ("graph", "graph LR\na --> b", "header"),
        ("chars", h + "a --> b\n" + "c --> " + "d" * 2000, "characters"), ("lines", h + "a --> b\n" * 40, "lines"), ("comment", h + "%% x", "directive"), ("data", h + "a@{ shape: x }", "shape data"), ("class", h + "a:::b --> c", "shorthand"),
        ("click", h + "a-->b; click a x", "styling"), ("style", h + "  style a fill:#fff", "styling"), ("url", h + 'a["https://x"]', "address"), ("two", h + "a --> b\nflowchart TB", "second header"), ("tag", h + 'a["<b>x</b>"]', "markup"),
        ("ids", h + 'a["component:core/x"]', "ids"), ("nodes", h + "\n".join(f"n{i} --> n{i + 1}" for i in range(12)), "nodes"), ("twelve", h + "\n".join(f"n{i} --> n{i + 1}" for i in range(11)), None),
    ]
    df = spark.createDataFrame([r[:2] for r in rows], "id string, source string")
    assert _faults(V.flowcharts(df)) == {r[0]: r[2] for r in rows if r[2]}

"""Question tokens and sections of answers against plain computations."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from strataloom.operators import retrieval as T
from strataloom.operators import sections as S


def _words(text):
    for chunk in re.split(r"[^A-Za-z0-9]+", text):
        yield from filter(None, re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1 \2", re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", chunk)).lower().split(" "))


def _kept(words):
    good = lambda w: len(w) >= 2 and not w.isdigit() and w not in T.STOPWORDS
    return [s for s in map(T.stem_word, filter(good, words)) if len(s) >= 2 and s not in T.STOPWORDS]


def test_compounds_are_counted(spark):
    t = "getURLParts plain x.GitHubClient aVeryLongIdentifierName HTTPServer parseURL2 ABC"
    got = {r.term: r.tf for r in T.term_counts(spark.createDataFrame([(1, t)], "doc int, t string"), ["doc"], F.col("t")).collect()}
    want = _kept(list(_words(t)) + ["geturlparts", "githubclient", "httpserver", "parseurl2"])
    assert got == {w: want.count(w) for w in want}


def test_question_tokens_join_what_is_known(spark):
    vocabulary = spark.createDataFrame([(T.stem_word(w),) for w in ("fallback", "github", "scanner", "layout")], "term string")
    asked = spark.createDataFrame([("a", "Where does it fall back to disk"), ("b", "GitHub layout"), ("c", "parseFile fall back back"), ("d", "the of 12"), ("e", "")], "q string, text string")
    got = {}
    for r in T.question_tokens(asked, vocabulary).orderBy("position").collect():
        got.setdefault(r.q, []).append(r.token)
    assert got == {"a": ["fallback", "fall", "back", "disk"], "b": ["github", "layout"], "c": ["par", "file", "fallback", "fall", "back"]}


def test_deletions_find_all_edits(spark):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abc") for _ in range(rnd.randrange(3, 9)))
    vocabulary = sorted({word() for _ in range(400)})
    asked = sorted({word() for _ in range(60)} - set(vocabulary))
    got = {}
    rows = T.expand(spark.createDataFrame([("q", a) for a in asked], "q string, token string"), spark.createDataFrame([(v, 1) for v in vocabulary], "term string, df int"))
    for r in rows.collect():
        got.setdefault(r.token, {})[r.term] = r.weight
    for a in asked:
        most = 2 if len(a) >= 7 else 1
        want = {v: T.FUZZY_WEIGHT for v in vocabulary if _distance(a, v) <= most}
        for v in vocabulary:
            if len(a) >= 4 and v.startswith(a) and len(v) > len(a) + most:
                want[v] = T.PREFIX_WEIGHT
        assert got.get(a, {}) == dict(sorted(want.items())[: T.MOST_EXPANSIONS])


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def _window(lines, hits, most):
    center = max(range(len(lines)), key=lambda i: (hits[i], -i))
    start = end = center
    size = len(lines[center])
    while True:
        before = len(lines[start - 1]) + 1 if start else None
        after = len(lines[end + 1]) + 1 if end < len(lines) - 1 else None
        grow = min((x for x in (before, after) if x is not None), default=None)
        if grow is None or size + grow > most:
            return start, end
        if after is None or before is not None and before <= after:
            start -= 1
        else:
            end += 1
        size += grow


def test_excerpts_equal_a_plain_walk(spark):
    rnd = random.Random(9)
    texts = {d: "\n".join(" ".join(rnd.choice(["alpha", "beta", "license", "licenses", "x", ""]) for _ in range(rnd.randrange(0, 40))) for _ in range(rnd.randrange(1, 60))) for d in range(20)}
    texts[18], texts[19] = "", "z" * 5000
    sections = [("q", d, d + 1) for d in texts]
    got = S.excerpts(spark.createDataFrame(sections, "q string, doc int, position int"), spark.createDataFrame(list(texts.items()), "doc int, text string"), spark.createDataFrame([("q", T.stem_word("license"))], "q string, term string"))
    short = lambda x: x if len(x) <= 240 else x[:239] + "…"
    for r in got.collect():
        lines = [short(x) for x in texts[r.doc].split("\n")]
        if r.position <= 6:
            size, n = 0, 0
            while n < len(lines) and not (n and size + len(lines[n]) + 1 > 2200):
                size, n = size + len(lines[n]) + 1, n + 1
            want = ("body", 1, "\n".join(lines[:n]))
        elif r.position <= 16:
            hits = [sum(w == T.stem_word("license") for w in _kept(_words(x))) for x in lines]
            start, end = _window(lines, hits, 500)
            want = ("window", start + 1, "\n".join(lines[start : end + 1]))
        else:
            want = ("none", None, "")
        assert (r.tier, r.start_line, r.excerpt or "") == want, r.doc


def test_symbols_and_files(spark):
    rows = [("q", "f", 1, "a/scan.ts", "helper", "scan scan", 1.0), ("q", "f", 2, "a/scan.ts", "scanTree", "", 0.5), ("q", "f", 3, "a/scan.ts", "scan", "x", 0.1), ("q", "f", 4, "a/scan.ts", "other", None, 9.0), ("q", "f", 5, "a/scan.ts", "zebra", "tree", 0.0)]
    df = spark.createDataFrame(rows, "q string, file string, doc int, path string, name string, body string, score double")
    terms = spark.createDataFrame([("q", "scan"), ("q", "tre"), ("q", "tree")], "q string, term string")
    assert [r.doc for r in S.symbol_order(df, terms).orderBy("place").collect()] == [2, 3, 1, 5, 4]
    scores = spark.createDataFrame([("q", 1, 2.0), ("q", 2, 3.0), ("q", 3, 0.0), ("q", 4, 1.0)], "q string, doc int, score double")
    files = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 9)], "doc int, file int")
    assert {(r.file, r.score, r.symbols) for r in S.file_groups(scores, files).collect()} == {(1, 2.0, 1), (9, 0.0, 1)}
    words = spark.createDataFrame([("atlas",), ("atlsa",), ("atlos",), ("loom",), ("loo",), ("lo",)], "token string")
    known = spark.createDataFrame([("atlos",)], "term string")
    assert {r.token for r in S.names_system(words, ["atlas", "loom"], known).collect()} == {"atlas", "loom", "loo"}

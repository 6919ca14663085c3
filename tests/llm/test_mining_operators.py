"""Hard negatives, fill-in-middle and language identification against brute force, enumeration and held-out rows."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strataloom.llm import fill_middle, hard_negatives, language_id

SF = "/root/testdata/sf0.01"
NAN, INF = float("nan"), float("inf")


# hard negatives


def brute_negatives(rows, every, positives, negatives, low=30, high=90, scale=256, most=1 << 55):
    """By sorting all rows for each anchor; one row for each id."""
    own = {}
    for i, v, lab in rows:
        if i is None or lab is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [math.floor(max(min(scale * float(np.float32(x)), 2.0**60), -(2.0**60))) for x in v]
        own[i] = min(own.get(i, (lab, q)), (lab, q))
    score = lambda a, b: max(-most, min(most, sum(x * y for x, y in zip(own[a][1], own[b][1]))))
    out = []
    for a in sorted(i for i in own if i % every == 0):
        ranked = sorted((-score(a, i), i) for i in own if i != a)
        for s, p in [x for x in ranked if own[x[1]][0] == own[a][0]][:positives]:
            fit = [(n, i) for n, i in ranked if own[i][0] != own[a][0] and low * -s <= 100 * -n <= high * -s]
            out += [(a, p, r, i, -s, -n) for r, (n, i) in enumerate(fit[:negatives], 1)]
    return sorted(out)


def mined(spark, rows, every, positives, negatives, page=2048):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"id": F.lit("x"), "score": F.lit(1), "rank": F.lit(None)})
    return sorted(tuple(r) for r in hard_negatives.hard_negatives(df, F.col("vec_id") % every == 0, positives, negatives, page=page).collect())


def _vectors(rnd, n, dims, labels, size=1.0):
    return [(i, [rnd.uniform(-size, size) for _ in range(dims)], rnd.randrange(labels)) for i in range(n)]


@pytest.mark.parametrize("slack", [0, 64])
def test_negatives_equal_sorting(spark, monkeypatch, slack):
    monkeypatch.setattr(hard_negatives, "SLACK", slack)
    rnd = random.Random(slack)
    rows = _vectors(rnd, 120, 5, 3)
    hot = [rnd.uniform(0, 1) for _ in range(5)]
    rows += [(1000 + 7 * i, hot, i % 4) for i in range(90)]  # copies: only ids tell them apart
    rows += [(i - (1 << 62), [0.5 * x for x in hot], i % 2) for i in range(20)]  # far ids, negative ones too
    rnd.shuffle(rows)
    want = brute_negatives(rows, 25, 3, 4)
    assert len(want) > 50
    assert mined(spark, rows, 25, 3, 4, page=3) == want


def test_negatives_of_odd_rows(spark):
    rnd = random.Random(5)
    rows = _vectors(rnd, 40, 4, 2)
    rows += [(None, [1.0] * 4, 1), (100, None, 1), (101, [1.0, None, 1.0, 1.0], 1), (102, [NAN] * 4, 0), (103, [INF, 1.0, 1.0, 1.0], 0), (104, [1.0] * 4, None)]
    rows += [(5, [9.0] * 4, 1), (5, [0.1] * 4, 0), rows[3], (110, [1.0, 0.5], 1), (120, [], 0), (130, [0.0] * 4, 0)]
    assert mined(spark, rows, 10, 2, 3) == brute_negatives([(i, v if v is None else v + [0.0] * (4 - len(v)), lab) for i, v, lab in rows], 10, 2, 3)


@pytest.mark.parametrize("size", [300.0, 1e5, 1e30])
def test_negatives_of_large_components(spark, size):
    rows = _vectors(random.Random(3), 60, 6, 3, size)
    assert mined(spark, rows, 20, 3, 5) == brute_negatives(rows, 20, 3, 5)


def test_negatives_of_no_rows(spark):
    assert mined(spark, [], 10, 2, 3) == []
    assert mined(spark, [(1, [1.0], 0), (2, [1.0], 1)], 10, 2, 3) == []
    assert mined(spark, [(10, [1.0], 0), (2, [1.0], 1)], 10, 2, 3) == []


# fill-in-middle

PIECES = ["a", "b ", "\n", "\n\n", "é", "😀", "<P", ">", "<P>", "<S>", "<M>", "<", " "]


def brute_fim(doc_id, text, seed=7):
    text = text or ""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, _, h4 = (int(h[8 * j : 8 * j + 8], 16) for j in range(4))
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    if not text or re.search("<[PSM]>", text):
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    return (doc_id, n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}") if h4 % 100 < 50 else (doc_id, n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab \né😀"), max_size=60), max_size=6), st.sampled_from([1, 2, 3, 7, 1000]), st.sampled_from([4, 1 << 22]))
def test_chunks_count_and_cut_like_one_scan(texts, size, slab):
    raw = [t.encode() for t in texts]
    before, fill_middle.SLAB = fill_middle.SLAB, slab
    try:
        for name, pattern in (("lines", r"[^\n]*\n|[^\n]+"), ("characters", r"(?s)."), ("words", r"(?s)\A\s*\S*\s*|\S+\s*")):
            chunks = fill_middle.Chunks(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), fill_middle.UNITS[name], size)
            for i, t in enumerate(texts):
                units = re.findall(pattern, t) if t else []
                if name == "words" and t[:1].isspace():
                    units = re.findall(r"(?s)\A\s+|\S+\s*", t)
                assert chunks.n_units()[i] == len(units)
                for k in range(len(units) + 1):
                    own = "".join(units[:k])
                    assert chunks.cut(i, k) == (len(own.encode()), len(own))
    finally:
        fill_middle.SLAB = before


def test_fill_in_middle(spark):
    rnd = random.Random(4)
    rows = [(i, "".join(rnd.choice(PIECES) for _ in range(rnd.randrange(40))) if i % 3 else "".join(rnd.choice(PIECES[:6]) for _ in range(rnd.randrange(60)))) for i in range(300)]
    rows += [(None, "no\nid\n"), (900, None), (901, ""), (901, ""), (902, "one line"), (902, "one line"), (903, "ü line\n" * 120_000), (904, "é" * 400_000), (-5, "a\nb")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"output": F.lit("x"), "form": F.lit(3), "n": F.lit(None)}).repartition(3)
    made = fill_middle.fill_in_middle(df)
    key = lambda r: (r[0] is None, r[0] or 0, r[5])
    got = sorted(map(tuple, made.collect()), key=key)
    assert got == sorted((brute_fim(*r) for r in rows), key=key)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    back = {(r.doc_id, r.t) for r in made.select("doc_id", fill_middle.restored(F.col("output"), F.col("form")).alias("t")).collect()}
    assert back == {(i, t or "") for i, t in rows}
    assert fill_middle.fill_in_middle_digest(df.limit(0)).count() == 0


def test_fill_in_middle_with_other_sentinels_and_rates(spark):
    marks = ("[[pre]]", "$suf^", "(mid)")
    df = spark.createDataFrame([(i, f"some words {i} and\nsome more of them") for i in range(200)], "doc_id long, text string")
    made = fill_middle.fill_in_middle(df, seed=1, fim_percent=60, spm_percent=20, units="words", sentinels=marks)
    back = made.join(df, "doc_id").select("form", "text", fill_middle.restored(F.col("output"), F.col("form"), marks).alias("t")).collect()
    assert all(r.t == r.text for r in back)
    forms = [r.form for r in back]
    assert 55 < forms.count("plain") < 105 and 8 < forms.count("spm") < forms.count("psm")


# languages

LATIN = {"aa": ["kata", "lomi", "sera", "tilo"], "bb": ["wurst", "brecht", "schlag", "pfund"]}


@settings(max_examples=120, deadline=None)
@given(st.data())
def test_labels_are_the_best_path(data):
    n, size = data.draw(st.integers(1, 3)), data.draw(st.integers(1, 5))
    scores = np.array([[data.draw(st.sampled_from([0.0, -1.0, -2.5, -7.0, language_id._NEVER])) for _ in range(n)] for _ in range(size)])
    scores[np.arange(size), [data.draw(st.integers(0, n - 1)) for _ in range(size)]] = 0
    texts = data.draw(st.lists(st.lists(st.integers(0, size - 1), max_size=6), min_size=1, max_size=4))
    penalty = data.draw(st.sampled_from([0.5, 1.0, 3.0]))
    ends = np.cumsum([0, *map(len, texts)])
    got = language_id.best_labels(np.array([w for t in texts for w in t], np.int64), ends, scores, penalty, longest=data.draw(st.sampled_from([1, 2, 100])))
    for i, t in enumerate(texts):
        value = lambda p: sum(scores[w, k] for w, k in zip(t, p)) - penalty * sum(a != b for a, b in zip(p, p[1:]))
        if t:
            assert value(got[ends[i] : ends[i + 1]].tolist()) == pytest.approx(max(map(value, itertools.product(range(n), repeat=len(t)))))


@pytest.fixture(scope="module")
def model(spark):
    rnd = random.Random(2)
    rows = [(i, " ".join(rnd.choice(LATIN[k]) for _ in range(30)), k) for i in range(40) for k in ("aa", "bb")]
    rows += [(i, "привет мир слово дело", "cc") for i in range(40)] + [(7, None, "aa"), (8, "nolang", None), (None, "kata", "aa")]
    return language_id.fit_language_model(spark.createDataFrame(rows, "doc_id long, text string, lang string"), ~language_id.held_out())


def test_scripts_narrow_the_languages(model):
    assert model.languages == ("aa", "bb", "cc")
    scores, letters, known = model.score(["привет", "kata", "ελλας", "日本語"])
    assert (scores[0] > language_id._NEVER).tolist() == [False, False, True] and (scores[1] > language_id._NEVER).tolist() == [True, True, False]
    assert known.tolist() == [True, True, False, False] and not scores[2:].any() and letters.tolist() == [6, 4, 5, 3]


def test_spans_of_mixed_texts(spark, model):
    a, b, c = "kata lomi sera tilo " * 5, "wurst brecht schlag pfund " * 6, "слово дело мир " * 4
    rows = [(1, a + b), (2, b + c + a + "日本 " * 3), (3, None), (4, "123 ?! ²½"), (5, ""), (6, "日本語"), (None, a), (1, a + b), (7, (a * 900) + (b * 1500)), (8, "k" * 100_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"score": F.lit("x"), "spans": F.lit(1), "lang": F.lit("bb")}).repartition(3)
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.lang_pred, r.score, [(s.lang, s.first_word, s.words, s.letters) for s in r.spans]) for r in language_id.language_spans(df, model).collect()), key=lambda r: r[:2])
    by_id = {r[1]: r[2:] for r in got}
    assert len(got) == len(rows)
    assert by_id[1] == ("bb", pytest.approx(132 / 212), [("aa", 0, 20, 80), ("bb", 20, 24, 132)])
    assert [s[0] for s in by_id[2][2]] == ["bb", "cc", "aa"] and by_id[2][2][-1][1:3] == (36, 23)
    assert [by_id[k] for k in (3, 4, 5)] == [("und", 0.0, [])] * 3
    assert by_id[6][:2] == ("aa", 0.0) and got[-1][2] == "aa"
    assert [s[:3] for s in by_id[7][2]] == [("aa", 0, 18_000), ("bb", 18_000, 36_000)]
    assert by_id[8][2][0][3] == 100_000
    assert language_id.language_spans(df.limit(0), model).count() == 0
    assert {r.lang_pred for r in language_id.language_spans(df, None).collect()} == {"und"}


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "kata", None), (2, None, "aa")], "doc_id long, text string, lang string")
    assert language_id.fit_language_model(df, F.lit(True)) is None
    assert [r.lang_pred for r in language_id.language_id(df).collect()] == ["und", "und"]


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = language_id.language_id(docs).join(docs, "doc_id").collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    out = [r for r in rows if r.held_out]
    assert len(out) > 150 and sum(r.lang == r.lang_pred for r in out) >= 0.98 * len(out)

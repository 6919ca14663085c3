"""WARC, line dedup, quality rules, near duplicates and the pipeline against brute force."""

from __future__ import annotations

import gzip
import hashlib
import io
import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from strataloom.llm import line_dedup, near_dedup, quality, warc
from strataloom.llm.common import materialize, scratch_dir

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{i}" for i in range(4000)]


def _doc(rnd, n):
    return [rnd.choice(WORDS) for _ in range(n)]


def _components(rows, words=5, percent=75):
    """Brute force over all pairs: (size, least id reachable) by position."""
    sets = []
    for _, t in rows:
        w = [x for x in (t or "").encode().lower().replace(b"\x0b", b" ").replace(b"\x0c", b" ").split()]
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            inter = len(sets[i] & sets[j])
            if inter and 100 * inter >= percent * len(sets[i] | sets[j]):
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[top(i)] = min(least.get(top(i), k), k)
    return [(len(sets[i]), least[top(i)]) for i in range(len(rows))]


@pytest.fixture(scope="module")
def corpus():
    """Clusters of near copies around the threshold, exact copies, a passage that many documents share, odd texts."""
    rnd = random.Random(11)
    texts = []
    for _ in range(8):
        base = _doc(rnd, rnd.choice([30, 120, 400]))
        for _ in range(14):
            t = list(base)
            for _ in range(rnd.randrange(0, max(2, len(t) // 25))):
                t[rnd.randrange(len(t))] = rnd.choice(WORDS)
            texts.append(" ".join(t))
    passage = _doc(rnd, 60)
    texts += [" ".join(_doc(rnd, 15) + passage + _doc(rnd, rnd.randrange(5, 30))) for _ in range(40)]
    texts += [" ".join(_doc(rnd, rnd.randrange(40, 200))) for _ in range(30)]
    texts += [texts[0]] * 9 + ["", "one two", "One TWO", "one two three four", None, "  \n\t "]
    ids = rnd.sample(range(5000), len(texts))
    return list(zip(ids, texts))


def test_near_duplicates_equal_brute_force(spark, corpus):
    df = spark.createDataFrame([(i, t, "x") for i, t in corpus], "doc_id long, text string, kept string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(df).collect()}
    want = {i: (n, c, c == i) for (i, _), (n, c) in zip(corpus, _components(corpus))}
    assert got == want
    assert len({c for _, c, _ in got.values()}) < len(corpus)


def test_block_search_finds_what_pivots_leave(spark, corpus):
    """Without pivot rounds all links must come from the exact search between components."""
    df = spark.createDataFrame(corpus, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df, rounds=1).collect()}
    assert got == {i: c for (i, _), (_, c) in zip(corpus, _components(corpus))}


def test_sets_listed_whole_meet_larger_ones(spark):
    """Isolated pairs: sets that are listed whole against larger ones that hold all or all but one of them."""
    rnd, texts = random.Random(11), []
    for k, n, alone in ((30, 39, 0), (30, 40, 0), (61, 80, 0), (62, 82, 0), (63, 84, 0), (63, 81, 1), (30, 41, 0)):
        for _ in range(40):
            words = [f"w{rnd.getrandbits(60):x}" for _ in range(n + 4 + alone)]
            texts += [" ".join(words[: k + 4 - alone] + words[n + 4 :]), " ".join(words[: n + 4])]
    corpus = list(enumerate(texts))
    df = spark.createDataFrame(corpus, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(df).collect()}
    assert got == {i: c for (i, _), c in zip(corpus, _components(corpus))}
    assert len({c for _, c in got.values()}) == 7 * 40 + 40  # 30 of 41 is under three quarters


def test_least_shared_is_the_worst_case():
    most = near_dedup.LISTED
    for k in range(1, most):
        worst = [i if n <= most else max(most - (n - i), near_dedup._sure_hits(most, 75, near_dedup.LIST_RISK)) for n in range(1, 2 * most) for i in range(min(k, n) + 1) if 100 * i >= 75 * (k + n - i)]
        assert near_dedup._least_shared(k, 75) == min(worst)
    assert near_dedup._least_shared(most, 75) == near_dedup._sure_hits(most, 75, near_dedup.LIST_RISK) and near_dedup._estimate(75) == 30 / 64


def test_block_links_both_ways():
    rnd = np.random.default_rng(3)
    base = np.arange(0, 6000, 3)
    sets = [np.unique(np.concatenate([np.delete(base, rnd.choice(2000, k, replace=False)), rnd.integers(7000, 9000, k)])) for k in (0, 100, 200, 300, 400, 500, 50, 20)]
    sets = [np.unique(near_dedup.np.int64(1) * s * 2654435761 % (1 << 61)) for s in sets]
    rep, comp = np.arange(8), np.arange(8)
    outside = np.array([1, 0, 1, 0, 1, 0, 1, 0], bool)
    links = near_dedup._block_links(rep, comp, outside, sets, 75)
    want = {(i, j) for i in range(8) for j in range(8) if outside[i] and not outside[j] and near_dedup._similar(sets[i], sets[j], 75)}
    assert set(links) <= want and (bool(links) == bool(want))
    joined = near_dedup._overlaps([sets[i] for i in (0, 2)], [sets[i] for i in (1, 3)], wide=100)
    assert joined.tolist() == [[len(np.intersect1d(sets[i], sets[j])) for j in (1, 3)] for i in (0, 2)]


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 102), (7, 7)]
    random.Random(1).shuffle(edges)
    got = {r.node: r.component for r in near_dedup.connected_components(spark.createDataFrame(edges, "a long, b long").repartition(4)).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 102: 100}


def test_near_duplicates_of_odd_tables(spark):
    assert near_dedup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (2, "a b c d e f"), (9, None)], "doc_id long, text string")
    got = Counter((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(df).collect())
    assert got == Counter({(None, None, True): 1, (4, 2, False): 2, (2, 2, True): 1, (9, 9, True): 1})


def _lines_brute(rows, size=3):
    seen, out = {}, []
    for i, t in sorted(rows):
        lines = (t or "").split("\n")
        gone = set()
        for p in range(len(lines) - size + 1):
            w = tuple(x.strip(" ") for x in lines[p : p + size])
            if any(w) and seen.setdefault(w, (i, p)) != (i, p):
                gone |= set(range(p, p + size))
        out.append((i, len(lines), len(gone), "\n".join(x for k, x in enumerate(lines) if k not in gone)))
    return out


def test_line_dedup_equals_brute_force(spark):
    rnd = random.Random(5)
    rows = [(i, "\n".join(rnd.choice(["alpha", " beta ", "beta", "gamma", "", "delta"]) for _ in range(rnd.randrange(0, 12)))) for i in range(60)] + [(100, None), (101, ""), (102, "a\nb"), (103, "\n\n\n\n")]
    df = spark.createDataFrame([(i, t, "z", 5) for i, t in rows], "doc_id long, text string, n_lines string, extra int").repartition(4)
    got = sorted((r.doc_id, r.n_lines, r.n_removed, r.text) for r in line_dedup.line_dedup(df).collect())
    assert got == _lines_brute(rows)
    assert line_dedup.line_dedup(df).columns == ["doc_id", "text", "extra", "n_lines", "n_removed"]
    assert line_dedup.line_dedup(df.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "a\nb\nc"), (1, "a\nb\nc"), (None, "a\nb\nc\nd")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_removed) for r in line_dedup.line_dedup(twice).collect()) == [(0, 0), (1, 3), (1, 3)]


def test_warc_round_trip(spark):
    big, small = "<p>é" + "x" * 1200, "tiny\r\n\r\nWARC/1.1\r\n"
    rows = [(i, f"http://h/{i}", big) for i in range(40)] + [(100 + i, None, small) for i in range(3)] + [(200, "u\n v", None), (201, "", ""), (None, "n", big), (39, "http://h/39", big)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string").repartition(5)
    got = Counter(tuple(r) for r in warc.warc_round_trip(pages).collect())
    want = Counter()
    for i, _, h in rows:
        raw = (h or "").encode()
        again = h == big and i not in (39, None)
        want[(i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", 39 if again else None)] += 1
    assert got == want
    assert warc.warc_round_trip(pages.limit(0)).count() == 0


def test_archives_are_plain_warc(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", "x" * 1000), (2, "http://b/", "x" * 1000)], "page_id long, url string, html string")
    manifest = warc.write_warc(pages, f"file://{tmp_path}/w")
    raw = b"".join(gzip.decompress((tmp_path / "w" / r.file).read_bytes()) for r in manifest.collect())
    assert raw.count(b"WARC/1.1\r\n") >= 3 and raw.count(b"WARC-Type: revisit") == 1 and b"WARC-Refers-To-Target-URI: http://b/" in raw
    members = [f for r in manifest.collect() for f, _ in warc.parse_warc(io.BytesIO((tmp_path / "w" / r.file).read_bytes()))]
    assert sum(f["warc-type"] == "response" for f in members) == 1
    with pytest.raises(ValueError):
        list(warc.parse_warc(io.BytesIO(gzip.compress(b"WARC/1.1\r\nContent-Length: 50\r\n\r\nshort"))))


def test_base_counts():
    t = "a b c a b c x\n\na b\na b\n#$ <|>"
    assert quality.base_counts(t) == (13, 16, 5, 1, 6, True)
    assert quality.base_counts("") == (0, 0, 0, 0, 0, True)
    clean = " ".join(f"w{i}" for i in range(80))
    assert quality.base_counts(clean)[5] is False and quality.base_counts("a b c " * 40)[5] is True


def _plain_counts(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines, dup = [], 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.append(line)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    cover = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover), len(words) < 50 or 100 * len(cover) > 50 * len(words)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab #|<>\n\t\r\x0b\x0c\x1c\x85\u2028\xa0é\U0001f600*"), max_size=120))
def test_base_counts_equal_slow_expressions(t):
    assert quality.base_counts(t) == _plain_counts(t)
    long = t + " x" * 60
    assert quality.base_counts(long) == _plain_counts(long)


def test_field_fits_one_text_for_each_id(spark):
    """Thousands of rows of one labelled id are one text; the sample never holds more rows than it is bound to."""
    good, bad = "A sentence of words that ends well.\n" * 20, "### $$$ buy now !!! ###\n" * 20
    rows = [(1, good)] * 3000 + [(1, bad)] * 3 + [(i, good if i % 2 else bad) for i in range(2, 60)] + [(None, good), (61, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 60)] + [(1, 0), (None, 1), (61, 1)], "doc_id long, quality int")
    field = quality.fit_line_field(docs, labels, fit_docs=40)
    assert field.content_share(good) > 0.9 and field.content_share(bad) < 0.1
    mixed = (good + bad) * 2
    assert 0.2 < field.content_share(mixed) < 0.9


def test_viterbi_is_the_best_path():
    rnd = np.random.default_rng(2)
    field = quality.LineField(rnd.normal(size=(quality.N_FEATURES, 2)), rnd.normal(size=(2, 2)))
    for n in (1, 2, 7):
        x = rnd.normal(size=(n, quality.N_FEATURES)).astype(np.float32)
        s = x @ field.emit
        score = lambda y: sum(s[i, y[i]] for i in range(n)) + sum(field.move[y[i], y[i + 1]] for i in range(n - 1))  # noqa: B023, E731
        best = max(score([(m >> i) & 1 for i in range(n)]) for m in range(2**n))
        assert abs(score(field.decode(x)) - best) < 1e-5
    assert field.decode(np.zeros((0, quality.N_FEATURES))) == []


def test_quality_on_held_out_labels(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    train = labels.where("doc_id % 2 = 0")
    got = quality.quality_rules(docs, train).join(labels.where("doc_id % 2 = 1"), "doc_id").where("NOT base_failed")
    right = got.agg(F.avg((F.col("kept") == (F.col("quality") == 1)).cast("double"))).first()[0]
    assert right > 0.95
    none = quality.quality_rules(docs.limit(5), labels.limit(0))
    assert none.where("content_share IS NULL").count() == 5
    odd = spark.createDataFrame([(None, None, "k"), (1, "", "k")], "doc_id long, text string, kept string")
    assert [r.kept for r in quality.quality_rules(odd, labels).collect()] == [False, False]


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plain = [(r.doc_id, r.text) for r in docs.collect()]
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "MinHash near-dedup", "best-fit packing"]
    stages = []
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), "stage")
        stages.append(docs)
    for s in stages[:-1]:
        assert s.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    kept = sorted((r.doc_id, r.text) for r in stages[0].collect())
    assert set(kept) <= set(plain) and not any(quality.base_counts(t)[5] for _, t in kept)
    clean = sorted((r.doc_id, r.text) for r in stages[1].collect())
    assert clean == [(i, t) for i, _, _, t in _lines_brute(kept)]
    assert all(r.n_chars == len(r.text) for r in stages[1].collect())
    left = sorted((r.doc_id, r.text) for r in stages[2].collect())
    assert left == sorted(x for x, (_, c) in zip(clean, _components(clean)) if c == x[0])
    packed = stages[3].groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert packed.where("n > 2048").count() == 0 and {r.doc_id for r in stages[3].collect()} == {i for i, _ in left}
    assert corpus_pipeline.run(spark, SF).count() == stages[3].count()


def test_scratch_needs_the_shared_folder(spark):
    assert scratch_dir(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


@pytest.fixture(scope="module")
def odd_documents(spark):
    """Nulls in any column, empty and very long texts, repeated rows and ids, columns named like results."""
    rnd = random.Random(21)
    text = lambda n: "\n".join(" ".join(rnd.choice(WORDS) for _ in range(12)) + "." for _ in range(n))
    same, long = text(9), text(9000)
    rows = [(1, same), (1, same), (2, same), (3, None), (4, ""), (5, long), (6, long + " end"), (None, same), (None, text(8)), (None, None), (7, text(7)), (7, text(7)), (2**60 + 1, text(9))]
    made = [(i, t, None if k % 3 else "en", "s", None if k % 2 else 5, "l", 1, "c", "q", 2.5, "x") for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(made, SCHEMA + ", n_lines string, component_id int, kept string, piece string, offset double, body string").repartition(3)


def test_pipeline_stages_take_odd_tables(spark, odd_documents):
    key = lambda df: Counter((r.doc_id, r.text, r.n_lines, r.component_id, r.body) for r in df.collect())
    names = odd_documents.columns
    rows = key(odd_documents)
    docs = corpus_pipeline.quality_stage(spark, odd_documents, SF)
    assert docs.columns == names and key(docs) <= rows and not any(t in (None, "") for _, t, *_ in key(docs))
    lines = corpus_pipeline.line_stage(spark, odd_documents, SF)
    assert lines.columns == names and lines.schema["n_chars"].dataType == odd_documents.schema["n_chars"].dataType
    clean = key(lines)
    assert sum(clean.values()) == sum(rows.values()) and {k[2:] for k in clean} == {("l", 1, "x")}
    long = {i: t for i, t, *_ in clean if i in (5, 6)}
    assert long[5].count("\n") == 8999 and long[6].count("\n") <= 3
    near = key(corpus_pipeline.near_duplicate_stage(spark, odd_documents, SF))
    assert near == Counter({k: n for k, n in rows.items() if k[0] not in (2, 6)})
    packed = corpus_pipeline.packing_stage(spark, odd_documents, SF).collect()
    assert {r.doc_id for r in packed} == {k[0] for k in rows} and sum(r.piece == 0 for r in packed) == sum(rows.values())
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd_documents.limit(0), SF).count() == 0


def test_long_texts(spark):
    rnd = random.Random(2)
    long = " ".join(rnd.choice(WORDS) for _ in range(400_000))
    df = spark.createDataFrame([(1, long), (2, long + " tail"), (3, "short text of a few words only")], "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(df).collect()} == {1: (len(near_dedup.shingle_set(long)), 1), 2: (len(near_dedup.shingle_set(long + " tail")), 1), 3: (3, 3)}
    counts = {r.doc_id: r.n_words for r in quality.quality_rules(df, spark.createDataFrame([], "doc_id long, quality int")).collect()}
    assert counts == {1: 400_000, 2: 400_001, 3: 7}
    pages = df.selectExpr("doc_id AS page_id", "'http://h/' AS url", "text AS html")
    assert {r.page_id: r.payload_bytes for r in warc.warc_round_trip(pages).collect()} == {1: len(long), 2: len(long) + 5, 3: 30}
    assert {r.doc_id: len(r.text) for r in line_dedup.line_dedup(df).collect()}[1] == len(long)


def test_hot_centres_and_pivots(spark):
    """One star of thousands, chains into it, and a crowd of near copies: hot keys are split, results stay the same."""
    edges = [(0, i) for i in range(1, 3000)] + [(i, i + 5000) for i in range(1, 3000, 7)] + [(9000, 9001)]
    random.Random(1).shuffle(edges)
    got = {r.node: r.component for r in near_dedup.connected_components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    assert got == {n: 9000 if n >= 9000 else 0 for e in edges for n in e}
    rnd = random.Random(5)
    base = _doc(rnd, 90)
    texts = []
    for _ in range(700):
        t = list(base)
        for _ in range(rnd.randrange(0, 6)):
            t[rnd.randrange(90)] = rnd.choice(WORDS)
        texts.append(" ".join(t))
    corpus = list(enumerate(texts))
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(corpus, "doc_id long, text string")).collect()}
    assert got == {i: c for (i, _), (_, c) in zip(corpus, _components(corpus))}


def test_pipeline_clears_its_folders(spark):
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(shared.iterdir()) if shared.exists() else set()
    assert corpus_pipeline.run(spark, SF).count() > 0
    left = {p.name.rpartition("-")[0] for p in set(shared.iterdir()) - before}
    assert left <= {"MinHash-near-dedup", "packed"}
